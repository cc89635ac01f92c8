"""Repeated word windows across documents, level by level: only repeated windows go on to twice their length."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.plans.staging import fresh_path, staged

WINDOW = 35  # words of a repeated window
LEVELS = 2  # lengths tried, each at most twice the one before
BLOCK_BYTES = 1 << 22  # of documents that travel together
BUCKET_BYTES = 1 << 24  # of a task
SHARD_BYTES = 1 << 24  # of documents, for each of which there is a shard of windows
PIECE_BYTES = 1 << 20  # of a text that is cut into words at once
WIDE = 1 << 16  # distinct words of a block whose numbers need more than two bytes

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))  # odd multipliers
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOW = np.uint64(0xFFFFFFFF)


def level_lengths(length: int, levels: int = LEVELS) -> list[int]:
    """Rising window lengths that end at ``length``, each half the next, rounded up."""
    out = [length]
    while len(out) < levels and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * _MIX[0] + b * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def extended(h: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Hashes of the windows of ``wanted`` words from those of ``size`` words, by doubling; the last step may overlap."""
    while size < wanted:
        step = min(size, wanted - size)
        h = _joined(h[:-step], h[step:]) if len(h) > step else h[:0]
        size += step
    return h


def _packed(raw: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, compressed."""
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=n * width, codec="zstd") if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _bits(raw: bytes | None, n: int) -> np.ndarray:
    """The first ``n`` bits, none of them set if there are no bytes."""
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if raw else np.zeros(n, dtype=bool)


class _Numbered(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; ``split`` on bytes cuts at ASCII white space only."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


class Block:
    """Documents that travel together: their ids, where each ends, and their words as numbers."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.ends = np.cumsum(np.array(row["sizes"], dtype=np.int64))
        raw = pa.decompress(row["vocabulary"], decompressed_size=row["vocabulary_bytes"], codec="zstd", asbytes=True)
        self.vocabulary = raw.split()
        total = int(self.ends[-1])
        self.words = _numbers(row["words"], total, np.uint32 if len(self.vocabulary) > WIDE else np.uint16)

    @staticmethod
    def pack(docs: list[tuple[int | None, bytes]]) -> dict:
        number, sizes, pieces = _Numbered(), [], []
        for _, text in docs:
            n = 0
            for words in _words(text):
                pieces.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
                n += len(words)
            sizes.append(n)
        words = np.concatenate([np.empty(0, np.uint32), *pieces])
        # Frequent words get small numbers, so that the upper bytes compress.
        order = np.argsort(-np.bincount(words, minlength=len(number)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        known = list(number)
        vocabulary = b" ".join([known[k] for k in order.tolist()])
        return {
            "ids": [i for i, _ in docs],
            "sizes": sizes,
            "vocabulary": pa.compress(vocabulary, codec="zstd", asbytes=True),
            "vocabulary_bytes": len(vocabulary),
            "words": _packed(rank[words].astype(np.uint32 if len(order) > WIDE else np.uint16)),
        }

    def hashes(self, lane: int, length: int) -> np.ndarray:
        """64-bit hashes of the window of ``length`` words from each place; the lanes are independent."""
        import xxhash

        seen = [xxhash.xxh3_64_intdigest(w, lane) for w in self.vocabulary]
        return extended(np.array(seen, dtype=np.uint64)[self.words], 1, length)

    def whole(self, length: int) -> np.ndarray:
        """At which places a window of ``length`` words of one document starts."""
        starts = np.zeros(max(0, len(self.words) - length + 1), dtype=bool)
        begin = 0
        for end in self.ends.tolist():
            if end - begin >= length:
                starts[begin : end - length + 1] = True
            begin = end
        return starts


def _candidates(block: Block, row: dict, length: int, before: int) -> np.ndarray:
    """Starts of windows of ``length`` whose two parts of ``before`` words are both repeated; all where that is 0."""
    starts = block.whole(length)
    if before:
        step, n = length - before, len(starts)
        held = _bits(row["mask"], max(0, len(block.words) - before + 1))
        starts &= held[:n] & held[step : step + n]
    return np.flatnonzero(starts)


def _distinct(block: Block, starts: np.ndarray, length: int, shards: int, exact: bool) -> tuple[np.ndarray, ...]:
    """Distinct windows as ``shard, low bits, check bits``, how often each occurs, and the number of every start's.

    A filter level tells windows apart by 32 bits in their shard: what agrees by chance goes on
    to the next level. The exact level adds another 64 bits of an independent hash.
    """
    h = block.hashes(0, length)[starts]
    key = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) << np.uint64(32)) | (h & _LOW)
    check = block.hashes(1, length)[starts] if exact else np.zeros(len(key), dtype=np.uint64)
    order = np.lexsort((check, key)) if exact else np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)]
    number = np.empty(len(k), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return (k[new] >> np.uint64(32)).astype(np.int32), (k[new] & _LOW).astype(np.uint32), c[new], np.bincount(number, minlength=int(new.sum())), number


_BLOCK = "ids array<bigint>, sizes array<bigint>, vocabulary binary, vocabulary_bytes bigint, words binary"
_ASKED = "shard int, block bigint, n bigint, low binary, checks binary, several binary"
_ANSWER = "block bigint, shard int, n bigint, repeated binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def block() -> pa.RecordBatch:
        row = Block.pack(held)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((i, text or b""))
            size += len(held[-1][1])
            if size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _ask(shards: int, length: int, before: int, exact: bool) -> Callable:
    """Per block and shard the distinct candidate windows, sorted, and which are repeated in the block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row)
            shard, low, check, times, _ = _distinct(block, _candidates(block, row, length, before), length, shards, exact)
            numbers, first = np.unique(shard, return_index=True)
            edges, out = np.append(first, len(shard)), []
            for s, a, b in zip(numbers.tolist(), edges[:-1], edges[1:], strict=True):
                gaps = np.diff(low[a:b], prepend=np.uint32(0))
                out.append((s, row["block"], int(b - a), _packed(gaps), check[a:b].tobytes() if exact else None, np.packbits(times[a:b] > 1).tobytes()))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["shard", "block", "n", "low", "checks", "several"],
                )

    return each


def _answer(exact: bool) -> Callable:
    """Which windows of a shard stand in several blocks or several times in one."""

    def of(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        low = np.concatenate([np.cumsum(_numbers(raw, n, np.uint32), dtype=np.uint32) for raw, n in zip(table.column("low").to_pylist(), sizes, strict=True)])
        check = np.frombuffer(b"".join(table.column("checks").to_pylist()), dtype=np.uint64) if exact else np.zeros(len(low), np.uint64)
        order = np.lexsort((check, low)) if exact else np.argsort(low, kind="stable")
        k, c = low[order], check[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        repeated = np.concatenate([_bits(b, n) for b, n in zip(table.column("several").to_pylist(), sizes, strict=True)])
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "n": table.column("n"),
                "repeated": pa.array([np.packbits(repeated[a:b]).tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary()),
            }
        )

    return of


def _mark(shards: int, length: int, before: int, exact: bool) -> Callable:
    """Per block a bit for each place: whether the window there is repeated; and how many are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row)
            starts = _candidates(block, row, length, before)
            number = _distinct(block, starts, length, shards, exact)[-1]
            answers = sorted(row["answers"] or [], key=lambda a: a["shard"])
            repeated = np.concatenate([np.empty(0, bool), *(_bits(a["repeated"], a["n"]) for a in answers)])
            marked = np.zeros(max(0, len(block.words) - length + 1), dtype=bool)
            marked[starts[repeated[number]]] = True
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([row["block"]]), "mask": pa.array([np.packbits(marked).tobytes()]), "left": pa.array([int(marked.sum())])}
            )

    return each


def _strip(length: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row)
            n = len(block.words)
            starts = np.flatnonzero(_bits(row["mask"], max(0, n - length + 1)))
            change = np.zeros(n + 1, dtype=np.int64)
            change[starts] += 1
            change[starts + length] -= 1
            gone = np.cumsum(change[:-1]) > 0
            spans, kept = [], []
            for a, b in zip(np.append(0, block.ends[:-1]).tolist(), block.ends.tolist(), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])))).tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(b" ".join(map(block.vocabulary.__getitem__, block.words[a:b][~gone[a:b]].tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, pa.int64()),
                    pa.array(np.diff(block.ends, prepend=0)),
                    pa.array(spans, pa.list_(span)),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_words", "spans", "kept"],
            )

    return each


def strip_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW, levels: int = LEVELS
) -> DataFrame:
    """Remove every word covered by a window of ``length`` words whose words also stand elsewhere.

    Returns ``doc_id, n_words, spans`` (maximal removed runs, ``start`` and ``end`` counted in
    words) and ``kept`` (the other words, joined by a space, as UTF-8 bytes) for every row of
    ``docs``. Words are what stands between ASCII white space, unchanged; windows never cross
    documents, overlap, and are judged on the texts as they came; a second place in the same
    document, or in a repeated row, counts. Null and empty texts have no words. Rows without an
    id take part like others; an empty table gives no rows; other columns are ignored.

    Documents are written once, as blocks of numbered words, bucketed so that no later join moves
    them. At each level a block sends its distinct windows to shards, which say which stand
    elsewhere; only a window whose halves are both repeated goes on to the next, doubled
    length, until the wanted length is reached or no candidate survives. Every level but the
    last is a filter on few bits; the last compares 96 bits within a shard.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    spark = docs.sparkSession
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first().n or 0
    buckets, shards = (max(1, -(-total // n)) for n in (BUCKET_BYTES, SHARD_BYTES))
    name = f"blocks_{uuid.uuid4().hex}"
    # The number is drawn once, when the table is written.
    (
        texts.mapInArrow(_to_blocks, _BLOCK)
        .withColumn("block", F.monotonically_increasing_id())
        .repartition(buckets, "block")
        .write.option("path", fresh_path(spark, "blocks"))
        .bucketBy(buckets, "block")
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    known, before = blocks.withColumn("mask", F.lit(None).cast("binary")), 0
    lengths = level_lengths(length, levels)
    for size in lengths:
        exact = size == length
        asked = known.mapInArrow(_ask(shards, size, before, exact), _ASKED)
        answered = asked.groupBy("shard").applyInArrow(_answer(exact), _ANSWER)
        answers = answered.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "repeated")).alias("answers"))
        marked = known.join(answers, "block", "left").mapInArrow(
            _mark(shards, size, before, exact), "block bigint, mask binary, left bigint"
        )
        masks = staged(marked, "window-masks")
        known, before = blocks.join(masks.select("block", "mask"), "block", "left"), size
        if not masks.agg(F.sum("left").alias("n")).first().n:
            known = blocks.withColumn("mask", F.lit(None).cast("binary"))
            break
    return known.mapInArrow(_strip(length), "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
