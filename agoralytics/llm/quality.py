"""Text quality by regularised quadratic discriminants over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.plans.staging import staged

SHRINK_TO_POOLED = 0.5
SHRINK_TO_DIAGONAL = 0.01
THRESHOLD = 0.7
FOLDS = 4
HELD_OUT_FOLD = 2

STATISTICS = (
    "log_words", "word_length", "upper", "digits", "marks", "exclamations", "bars", "stops",
    "lines", "unique_words", "top_word", "repeated_lines", "entropy",
)
_MARKS, _EXCLAMATIONS, _BARS, _STOPS = b"*#$%&@^~<>\\{}[]=_+", b"!?", b"|", b".,;:"


def _logit(share: float, n: int) -> float:
    """Log odds of a share of ``n``, kept finite by half a case on either side."""
    k = share * n
    return math.log((k + 0.5) / (n - k + 0.5))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text: counts as logarithms, shares as log odds of a few cases."""
    words = text.split()
    n, size = len(words), len(text)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)

    def of(chars: bytes) -> int:
        return int(count[np.frombuffer(chars, dtype=np.uint8)].sum())

    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    share = count[count > 0] / max(size, 1)
    per_word = 1 / max(n, 1)

    def rate(k: int) -> float:
        return math.log((k + 0.1) * per_word)

    return [
        math.log1p(n),
        math.log1p(size * per_word),
        _logit(upper / max(upper + lower, 1), upper + lower),
        rate(int(count[48:58].sum())),
        rate(of(_MARKS)),
        rate(of(_EXCLAMATIONS)),
        rate(of(_BARS)),
        rate(of(_STOPS)),
        rate(len(lines)),
        _logit(len(seen) * per_word, n),
        _logit(max(seen.values(), default=0) * per_word, n),
        rate(len(lines) - len(set(lines))),
        float(-(share * np.log(share)).sum()),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Class densities: a mean and the inverse Cholesky factor of a covariance per class.

    ``whiten[k] @ (x - mean[k])`` has unit covariance in class ``k``, so its squared length is
    the Mahalanobis distance, and ``offset[k]`` holds the log determinant and the log prior.
    """

    mean: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        logs = []
        for mean, whiten, offset in zip(self.mean, self.whiten, self.offset, strict=True):
            z = (x - mean) @ whiten.T
            logs.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the statistics of every row's whole text; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    text = F.col(text_col).cast("string").cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text).mapInArrow(
        each, "doc_id bigint, x array<double>"
    )


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT_FOLD) -> Column:
    """Whether an id is kept from learning; ids that are null always are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(
    observed: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    pooled: float = SHRINK_TO_POOLED,
    diagonal: float = SHRINK_TO_DIAGONAL,
) -> Discriminant:
    """Learn from all labelled rows of ``observed(doc_id, x)`` that are not held out.

    Counts, sums and sums of products per class are one distributed aggregation, so the driver
    receives two rows whatever the size. Each class covariance is shrunk towards the pooled one
    and that towards a multiple of the identity, in units of the pooled deviation. Labels other
    than 0 and 1 are ignored, a repeated label counts once. A class without two rows takes the
    pooled moments; without any labels every score is the prior, one half.
    """
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = observed.join(known.distinct(), "doc_id")
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("sums"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("products"),
    )
    n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums.collect():
        n[row.label], first[row.label] = row.n, row.sums
        for (i, j), value in zip(pairs, row.products, strict=True):
            second[row.label, i, j] = second[row.label, j, i] = value

    def covariance(n: float, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (second - np.outer(first, first) / n) / max(n - 1, 1)

    total = n.sum()
    centre = first.sum(axis=0) / max(total, 1)
    spread = np.ones(d)
    common = np.eye(d)
    if total > 1:
        spread = np.sqrt(np.maximum(np.diag(covariance(total, first.sum(axis=0), second.sum(axis=0))), 1e-6))
        own = [covariance(max(n[k], 1), first[k], second[k]) * max(n[k] - 1, 0) for k in (0, 1)]
        common = sum(own) / max(total - 2, 1) / np.outer(spread, spread)
    mean, whiten, offset = [], [], []
    for k in (0, 1):
        shrunk = common
        if n[k] > 1:
            shrunk = pooled * common + (1 - pooled) * covariance(n[k], first[k], second[k]) / np.outer(spread, spread)
        scale = max(np.trace(shrunk) / d, 1e-6)
        factor = np.linalg.cholesky((1 - diagonal) * shrunk + diagonal * scale * np.eye(d))
        mean.append(first[k] / n[k] if n[k] else centre)
        whiten.append(np.linalg.inv(factor) / spread)
        offset.append(math.log((n[k] + 1) / (total + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(mean), np.array(whiten), np.array(offset))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``score`` (0 to 1) is the probability of label 1 by quadratic discriminants learned from
    ``labels(doc_id, quality)``; ``predicted`` is 1 from ``threshold`` on. Scores depend on the
    text alone: equal texts score alike, null and empty ones like a document of no words.
    Repeated rows each return, an empty table gives no rows, other columns are ignored.
    The statistics are written once and read for learning and for scoring.
    """
    observed = staged(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(observed, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return observed.mapInArrow(score, "doc_id bigint, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; scored as they are read."""
    model = fit(staged(document_statistics(docs, id_col, text_col), "statistics"), labels)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(names.index(text_col)), pa.string()).to_pylist()
            x = np.array([statistics((t or "").encode()) for t in texts]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
