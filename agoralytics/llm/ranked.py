"""Ranked lexical search: bundles of queries pass through the owners of terms and gather scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.plans.staging import staged

TOP = 20
SLICE_DOCS = 4096  # documents whose scores are gathered together
SLICE_BYTES = 1 << 23  # of their texts
BUNDLE_ITEMS = 256  # queries that travel together
OWNERS = 4  # stages, from rare terms to frequent ones
OWNER_STEP = 4  # times as many documents may hold a term of the next owner
FILTER_BITS = 1 << 22  # of the table of term hashes, whatever the number of terms
MEMO_WORDS = 1 << 18  # remembered by a task

# Fixed values of the score.
WEIGHT_SCALE = 1000
NUMERATOR = 1_000_000_000
TF_SCALE = 1000
LENGTH_SCALE = 12
LENGTH_BASE, LENGTH_SHARE = 100, 25

# Everything but ASCII letters, digits and other characters than ASCII ends a term.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z in lower case; none of a null text."""
    return (text or b"").translate(_TERM_BYTES).split()


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (a number for each row), ``item_id``, ``term`` and how often the item holds it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (item, name, term, n)
                for item, name, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
                for term, n in Counter(terms(text)).items()
            ]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "item_id", "term", "times"]
                )

    rows = items.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("item_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    found = staged(rows.mapInArrow(each, "row bigint, item_id bigint, term string, times bigint"), "item-terms")
    # Numbers without gaps, by the task that read a row and its place there: one small row per task.
    per_row = found.select("row", "item_id").distinct().withColumn("task", F.shiftright("row", 33))
    within = F.row_number().over(Window.partitionBy("task").orderBy("row"))
    tasks = per_row.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    starts = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n") - 1).alias("start"))
    numbered = per_row.withColumn("place", within).join(starts, "task")
    numbered = numbered.select("row", (F.col("start") + F.col("place")).cast("bigint").alias("item"))
    return staged(found.join(numbered, "row").drop("row"), "numbered-terms")


def _filter(wanted: DataFrame) -> np.ndarray:
    """A table of ``FILTER_BITS`` bits with those of the wanted terms set. Its size is fixed."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    words = wanted.select(F.shiftright(bit, 6).alias("word"), one.alias("bits"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        table[row.word] = row.bits
    return table.view(np.uint64)


def _slices(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Slices of neighbouring documents: ids, term counts, and the postings of terms that may be wanted.

    A posting list is the places of documents in the slice and how often each holds the term.
    A bit table lets through every wanted term and few others, which later find no query.
    """
    fields = ["ids", "sizes", "terms", "holders", "places", "times"]
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo: dict[bytes, bool] = {}

        def passes(term: bytes) -> bool:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            bit = xxhash.xxh64_intdigest(term, 42) % FILTER_BITS  # as the built-in function, which is signed
            memo[term] = bool(int(wanted[bit >> 6]) >> (bit & 63) & 1)
            return memo[term]

        ids: list[int | None] = []
        sizes: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}
        held = 0

        def piece() -> pa.RecordBatch:
            row = (
                ids,
                sizes,
                [t.decode() for t in lists],
                [len(p) for p, _ in lists.values()],
                [np.array(p, dtype=np.uint16).tobytes() for p, _ in lists.values()],
                [np.array(n, dtype=np.uint32).tobytes() for _, n in lists.values()],
            )
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], fields)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                place = len(ids)
                ids.append(i)
                sizes.append(len(found))
                for term, n in Counter(found).items():
                    if memo[term] if term in memo else passes(term):
                        places, times = lists.setdefault(term, ([], []))
                        places.append(place)
                        times.append(n)
                held += len(text or b"")
                if len(ids) >= SLICE_DOCS or held >= SLICE_BYTES:
                    yield piece()
                    ids, sizes, lists, held = [], [], {}, 0
        if ids:
            yield piece()

    schema = "ids array<bigint>, sizes array<bigint>, terms array<string>, holders array<bigint>, places array<binary>, times array<binary>"
    return staged(docs.mapInArrow(each, schema).withColumn("slice", F.monotonically_increasing_id()), "slices")


def _weight(documents: int, holders: Column) -> Column:
    share = F.lit(float(2 * documents + 2)) / (2 * holders + 1).cast("double")
    return F.floor(F.lit(float(WEIGHT_SCALE)) * F.log(share)).cast("bigint")


def _owner(documents: int, holders: Column, owners: int) -> Column:
    """The stage that owns a term: each next one has terms that up to ``OWNER_STEP`` times as many documents hold."""
    owner = F.lit(owners - 1)
    for k in range(owners - 2, -1, -1):
        owner = F.when(holders * F.lit(OWNER_STEP ** (owners - 1 - k)) <= documents, k).otherwise(owner)
    return owner


_BUNDLE = "bundle bigint, slice bigint, ids array<bigint>, sizes array<bigint>, cells bigint, scores binary"
_FOUND = "item bigint, doc_id bigint, score bigint"


class _Scores:
    """The scores of a bundle's items in a slice; travelling, only the cells above 0."""

    def __init__(self, bundle: dict, items: int, documents: int, length: int):
        self.sizes = np.array(bundle["sizes"], dtype=np.int64)
        self.cells = np.zeros((items, len(self.sizes)), dtype=np.int64)
        if bundle["cells"]:
            n = bundle["cells"]
            raw = pa.decompress(bundle["scores"], decompressed_size=12 * n, codec="zstd", asbytes=True)
            at = np.cumsum(np.frombuffer(raw, dtype=np.uint32, count=n), dtype=np.int64)
            planes = np.frombuffer(raw, dtype=np.uint8, offset=4 * n).reshape(8, n)
            self.cells.ravel()[at] = np.ascontiguousarray(planes.T).view(np.int64).ravel()
        self.norm = LENGTH_BASE - LENGTH_SHARE + LENGTH_SHARE * self.sizes * documents // max(1, length)

    def add(self, items: np.ndarray, weights: np.ndarray, places: np.ndarray, times: np.ndarray) -> None:
        """Add one term: its weight in each item that holds it, times its part in each document."""
        times = times.astype(np.int64)
        part = NUMERATOR * times // (TF_SCALE * times + LENGTH_SCALE * self.norm[places])
        self.cells[np.ix_(items, places)] += weights[:, None] * part

    def travelling(self) -> tuple[int, bytes]:
        at = np.flatnonzero(self.cells)
        gaps = np.diff(at, prepend=0).astype(np.uint32)
        planes = np.ascontiguousarray(self.cells.ravel()[at].view(np.uint8).reshape(-1, 8).T)
        return len(at), pa.compress(gaps.tobytes() + planes.tobytes(), codec="zstd", asbytes=True)

    def best(self, ids: list[int | None], top: int) -> Iterator[tuple[int, int | None, int]]:
        """The best of every item by score, then by id; documents without an id come last among equals."""
        names = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        for item, row in enumerate(self.cells):
            at = np.flatnonzero(row)
            if len(at) > top:
                at = at[row[at] >= np.partition(row[at], -top)[-top]]
            for k in at[np.lexsort((names[at], -row[at]))][:top].tolist():
                yield item, ids[k], int(row[k])


def _pass_on(items: int, documents: int, length: int, top: int | None):
    """The work of an owner: add its postings to the bundles; the last one selects instead of passing on."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = left.to_pylist()[0]
        scores = _Scores(bundle, items, documents, length)
        for row in right.to_pylist():
            scores.add(
                np.array(row["items"], dtype=np.int64),
                np.array(row["weights"], dtype=np.int64),
                np.frombuffer(row["places"], dtype=np.uint16),
                np.frombuffer(row["times"], dtype=np.uint32),
            )
        if top is None:
            cells, raw = scores.travelling()
            return pa.table(
                {
                    "bundle": left.column("bundle"),
                    "slice": left.column("slice"),
                    "ids": left.column("ids"),
                    "sizes": left.column("sizes"),
                    "cells": pa.array([cells]),
                    "scores": pa.array([raw], pa.binary()),
                }
            )
        first = bundle["bundle"] * items
        found = [(first + item, doc, score) for item, doc, score in scores.best(bundle["ids"], top)]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return of


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    owners: int = OWNERS,
    bundle_items: int = BUNDLE_ITEMS,
) -> DataFrame:
    """The ``top`` documents for every item, ``item_id, rank, doc_id, score``, by an integer BM25 score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
    case, in whole texts; null texts have none. Every row of ``docs`` is a document and every
    row of ``items`` a query, repeated rows too. Scores above 0 only; equal scores go by
    ascending id, documents without an id last. An item without terms, or an empty table on
    either side, gives no rows. Other columns are ignored.

    One pass cuts the documents into slices and writes the postings of each slice, for the terms
    in a bit table of fixed size. Every term has an owner, a class of terms by the number
    of documents that hold them. A bundle of items starts with empty scores for each slice and
    visits the owners in turn: at each it meets that owner's postings of the slice, adds
    their parts, and travels on with the cells that are above 0. Rare terms come first, so few
    cells travel; the last owner adds the frequent terms and selects. A frequent term is
    spread over all slices. Only the best of each slice go to the final selection.
    """
    asked = _item_terms(items, item_col, item_text_col)
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    wanted = asked.select("term").distinct()
    slices = _slices(texts, _filter(wanted))
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, s: n + s)
    full = F.size(F.filter("sizes", lambda s: s > 0)).cast("bigint")
    totals = slices.agg(F.coalesce(F.sum(full), F.lit(0)).alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("length")).first()
    documents, length = totals.documents, totals.length
    lists = slices.select("slice", F.explode(F.arrays_zip("terms", "holders", "places", "times")).alias("list")).select(
        "slice", F.col("list.terms").alias("term"), "list.holders", "list.places", "list.times"
    )
    holders = lists.select("term", "holders").groupBy("term").agg(F.sum("holders").alias("holders"))
    # One row per term and bundle: which of the bundle's items hold the term, and its weight in each.
    bundled = (
        asked.join(holders, "term")
        .withColumn("weight", _weight(documents, F.col("holders")) * F.col("times"))
        .withColumn("owner", _owner(documents, F.col("holders"), owners))
        .withColumn("bundle", F.floor(F.col("item") / bundle_items).cast("bigint"))
        .groupBy("term", "owner", "bundle")
        .agg(F.collect_list(F.struct((F.col("item") % bundle_items).cast("int").alias("item"), "weight")).alias("parts"))
        .select("term", "owner", "bundle", F.col("parts.item").alias("items"), F.col("parts.weight").alias("weights"))
    )
    postings = staged(
        lists.join(bundled, "term").select("owner", "bundle", "slice", "items", "weights", "places", "times"), "postings"
    )
    last_item = asked.agg(F.max("item").alias("n")).first().n
    bundles = F.sequence(F.lit(0).cast("bigint"), F.lit((last_item or 0) // bundle_items).cast("bigint"))
    state = slices.select(
        F.explode(bundles).alias("bundle"), "slice", "ids", "sizes", F.lit(0).cast("bigint").alias("cells"), F.lit(b"").alias("scores")
    )
    for owner in range(owners):
        last = owner == owners - 1
        owned = postings.where(F.col("owner") == owner).drop("owner")
        work = _pass_on(bundle_items, documents, length, top if last else None)
        state = (
            state.groupBy("bundle", "slice").cogroup(owned.groupBy("bundle", "slice")).applyInArrow(work, _FOUND if last else _BUNDLE)
        )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = asked.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
