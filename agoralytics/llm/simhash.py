"""Near-duplicate documents by SimHash fingerprints and vantage-point partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.components import connected_components
from agoralytics.plans.staging import staged

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BITS = 64
FIT_SAMPLE = 1 << 15  # fingerprints from which the vantage points of the shards and their radii are chosen
SHARD_ROWS = 20_000  # fingerprints that a shard should be home to
CHUNK_SHARDS = 5  # visitors of a group, as a multiple of that
LEAF_SAMPLE = 4096  # fingerprints from which the tree inside a shard is fitted
LEAF_ROWS = 256  # of a tree inside a shard
DEAL_ROWS = 2048  # fingerprints dealt at a time
CHUNK_ROWS = 4096  # visitors compared at a time


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: a bit is 1 if more than half of the shingle hashes have it."""
    import xxhash

    parts = text.lower().split()  # both are ASCII only on bytes
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8"
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed 64-bit integer (null text: 0)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or b"", words) for t in batch.column(1).to_pylist()]
            found = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    text = F.col(text_col).cast("string").cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text).mapInArrow(each, "doc_id bigint, fp bigint")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


class VantageTree:
    """Shells around vantage points: a fingerprint's leaf, and all leaves within some bits of it.

    A node keeps a vantage point and a radius; its children hold what lies within that distance
    and what lies beyond. By the triangle inequality a fingerprint at distance ``d`` from the
    vantage point has its neighbours of at most ``bits`` within when ``d - bits <= radius``,
    and beyond when ``d + bits > radius``. Fitted on a bounded sample; every fingerprint has
    exactly one home, whether the sample held it or not.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, int, int, int] | None] = []
        self.leaves: dict[int, int] = {}
        self._grow(sample, leaves)

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        here = len(self.nodes)
        self.nodes.append(None)
        split = self._split(sample) if leaves > 1 and len(sample) > 1 else None
        if split is None:
            self.leaves[here] = len(self.leaves)
            return here
        point, radius, within = split
        share = min(leaves - 1, max(1, round(leaves * within.mean())))
        near = self._grow(sample[within], share)
        far = self._grow(sample[~within], leaves - share)
        self.nodes[here] = (int(point), radius, near, far)
        return here

    @staticmethod
    def _split(sample: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        """The vantage point among a few, and the radius, that leave the fewest near the border."""
        best = None
        for point in sample[:: max(1, len(sample) // 16)][:16]:
            away = np.bitwise_count(sample ^ point)
            for radius in np.unique(np.quantile(away, (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)).astype(int)):
                within = away <= radius
                inside = within.mean()
                if 0 < inside < 1:
                    home = max(inside, 1 - inside)
                    border = np.mean(np.abs(away.astype(int) - radius) <= MAX_BITS)
                    cost = (1 + border) * (home**2 + (1 - home) ** 2)
                    if best is None or cost < best[0]:
                        best = (cost, point, int(radius), within)
        return best and best[1:]

    def places(self, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``(index, leaf, home)``: every leaf within ``bits`` of each fingerprint."""
        index, leaf, home = [], [], []
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
        while stack:
            node, rows, own = stack.pop()
            if not len(rows):
                continue
            if self.nodes[node] is None:
                index.append(rows)
                leaf.append(np.full(len(rows), self.leaves[node], dtype=np.int32))
                home.append(own)
                continue
            point, radius, near, far = self.nodes[node]
            away = np.bitwise_count(fps[rows] ^ np.uint64(point)).astype(np.int32)
            for child, reach, inside in (
                (near, away - bits <= radius, away <= radius),
                (far, away + bits > radius, away > radius),
            ):
                stack.append((child, rows[reach], own[reach] & inside[reach]))
        if not index:
            return np.empty(0, int), np.empty(0, np.int32), np.empty(0, bool)
        return np.concatenate(index), np.concatenate(leaf), np.concatenate(home)


class Forest:
    """Disjoint sets over ``0..n-1``; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = up


def shard_links(
    home: np.ndarray, visitors: np.ndarray, bits: int, within: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked between ``home`` and ``visitors``, at most one per fingerprint.

    The home fingerprints become a vantage-point tree; every visitor, and with ``within`` every
    home fingerprint too, is compared with the leaves that its distance bounds leave open. Only
    the resulting components are returned.
    """
    every = np.concatenate((home, visitors))
    tree = VantageTree(home[:: max(1, len(home) // LEAF_SAMPLE)], max(1, len(home) // LEAF_ROWS))
    at, leaf, own = tree.places(home, 0)
    order = np.argsort(leaf, kind="stable")
    members = at[order]
    bounds = np.searchsorted(leaf[order], np.arange(len(tree.leaves) + 1))
    forest = Forest(len(every))
    for k in range(0 if within else len(home), len(every), CHUNK_ROWS):
        index, leaf, _ = tree.places(every[k : k + CHUNK_ROWS], bits)
        order = np.argsort(leaf, kind="stable")
        index, leaf = index[order] + k, leaf[order]
        edge = np.searchsorted(leaf, np.arange(len(tree.leaves) + 1))
        for n in range(len(tree.leaves)):
            rows, own = index[edge[n] : edge[n + 1]], members[bounds[n] : bounds[n + 1]]
            if len(rows) and len(own):
                i, j = np.nonzero(distances(every[rows], home[own]) <= bits)
                forest.link(rows[i], own[j])
    roots = forest.roots(np.arange(len(every)))
    moved = np.flatnonzero(roots != np.arange(len(every)))
    return every[moved], every[roots[moved]]


def _tree(distinct: DataFrame, shard_rows: int) -> VantageTree:
    total = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("fp"), "fp").limit(FIT_SAMPLE).collect()
    sample = np.array([r.fp for r in chosen], dtype=np.int64).view(np.uint64)
    return VantageTree(sample, max(1, -(-total // shard_rows)))


def _mixed(fps: np.ndarray) -> np.ndarray:
    """A hash of each fingerprint, so that like ones do not share a part."""
    x = fps * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Dealing:
    """Which groups a fingerprint is sent to: shards of a vantage-point tree, cut into parts.

    ``homes`` and ``visits`` are the numbers of fingerprints that live in each shard and that
    visit it. A shard of more than twice ``shard_rows`` homes is cut into parts of
    ``shard_rows``, its visitors into chunks of ``CHUNK_SHARDS`` times as many, both by a hash;
    each chunk needs its own copy of the part, so copies are a fifth of the visitors. Group
    ``(shard, part, chunk)`` holds one part as a tree; the visitors of the chunk, and the homes
    of the part ``chunk`` where that is no earlier, are looked up in it. So each pair of homes
    and each home and visitor meet in exactly one group, and a group holds ``2 + CHUNK_SHARDS``
    times ``shard_rows`` at most, up to the evenness of the hash.
    """

    TREE, TREE_AND_QUERY, QUERY = 0, 1, 2

    def __init__(self, tree: VantageTree, homes: np.ndarray, visits: np.ndarray, shard_rows: int):
        self.tree = tree
        self.parts = np.where(homes <= 2 * shard_rows, 1, -(-homes // shard_rows))
        self.chunks = np.maximum(1, -(-visits // (CHUNK_SHARDS * shard_rows)))

    @staticmethod
    def visited(tree: VantageTree, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``(index, shard, home)``; a visitor goes to shards after its own only."""
        index, shard, home = tree.places(fps, bits)
        own = np.zeros(len(fps), dtype=np.int32)
        own[index[home]] = shard[home]
        keep = home | (shard > own[index])
        return index[keep], shard[keep], home[keep]

    def groups(self, fps: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
        """Rows ``(shard, part, chunk, role, fingerprint)``."""
        index, shard, home = self.visited(self.tree, fps, bits)
        fps = fps[index]
        hashed = _mixed(fps)
        part = (hashed % self.parts[shard].astype(np.uint64)).astype(np.int64)
        chunk = (hashed % self.chunks[shard].astype(np.uint64)).astype(np.int64)

        def copies(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.repeat(rows, times)
            number = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            return row, number

        found = []
        # homes as the tree of every group of their part that looks something up in it
        rows = np.flatnonzero(home)
        row, number = copies(rows, np.maximum(self.parts, self.chunks)[shard[rows]])
        used = ((number >= part[row]) & (number < self.parts[shard[row]])) | (number < self.chunks[shard[row]])
        row, number = row[used], number[used]
        found.append((row, part[row], number, np.where(number == part[row], self.TREE_AND_QUERY, self.TREE)))
        # homes looked up in earlier parts
        row, number = copies(rows, part[rows])
        found.append((row, number, part[row], np.full(len(row), self.QUERY)))
        # visitors looked up in every part
        rows = np.flatnonzero(~home)
        row, number = copies(rows, self.parts[shard[rows]])
        found.append((row, number, chunk[row], np.full(len(row), self.QUERY)))
        row, part, chunk, role = (np.concatenate(c) for c in zip(*found, strict=True))
        return shard[row], part.astype(np.int32), chunk.astype(np.int32), role.astype(np.int8), fps[row]


def _dealing(distinct: DataFrame, bits: int, shard_rows: int) -> Dealing:
    """The tree, and the parts of its shards, from two counts per shard."""
    tree = _tree(distinct, shard_rows)
    shards = len(tree.leaves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, shards), dtype=np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), DEAL_ROWS):
                _, shard, home = Dealing.visited(tree, fps[k : k + DEAL_ROWS], bits)
                totals[0] += np.bincount(shard[home], minlength=shards)
                totals[1] += np.bincount(shard[~home], minlength=shards)
        seen = np.flatnonzero(totals.any(axis=0))
        columns = [pa.array(seen.astype(np.int32)), pa.array(totals[0, seen]), pa.array(totals[1, seen])]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "homes", "visits"])

    counted = distinct.mapInArrow(count, "shard int, homes bigint, visits bigint").groupBy("shard")
    homes, visits = np.zeros(shards, dtype=np.int64), np.zeros(shards, dtype=np.int64)
    for r in counted.agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).collect():
        homes[r.shard], visits[r.shard] = r.homes, r.visits
    return Dealing(tree, homes, visits, shard_rows)


def fingerprint_links(distinct: DataFrame, bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fp)`` that join all pairs within ``bits``.

    Fingerprints are dealt to the leaves of a vantage-point tree; each also visits every other
    leaf within ``bits`` of it, so each pair meets in the home of either. A visitor is needed
    on one side only and goes to leaves after its own. Shards receive distinct values: copies,
    however many, are one row. Leaves with many rows or many visitors are cut into groups of
    bounded size (``Dealing``); a first pass counts both.
    """
    dealing = _dealing(distinct, bits, shard_rows)
    names = ["shard", "part", "chunk", "role", "fp"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), DEAL_ROWS):
                *place, values = dealing.groups(fps[k : k + DEAL_ROWS], bits)
                yield pa.RecordBatch.from_arrays([*map(pa.array, place), pa.array(values.view(np.int64))], names)

    def links(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        role = table.column("role").to_numpy()
        tree, query = role != Dealing.QUERY, role == Dealing.QUERY
        within = bool(np.any(role == Dealing.TREE_AND_QUERY))
        a, b = shard_links(fps[tree], fps[query], bits, within) if tree.any() else (fps[:0], fps[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "shard int, part int, chunk int, role tinyint, fp bigint")
    return dealt.groupBy("shard", "part", "chunk").applyInArrow(links, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z, cut into words at ASCII white space, and hashed by ``words``
    at a time (XXH64, seed 42), repeats included; a text of fewer words is one shingle; a null,
    empty or blank text has the fingerprint 0, which links like any other. Documents link when
    their fingerprints differ in ``bits`` bits at most; ``component_id`` is the smallest
    ``doc_id`` reachable over links. Repeated rows each return; rows without an id take part
    through their fingerprint and return a null id. A component of rows without ids has a null
    component. An empty table gives no rows, other columns are ignored.
    """
    fps = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = staged(fingerprint_links(least.select("fp"), bits, shard_rows), "fingerprint-links")
    member = connected_components(links, "fingerprint-components")
    grouped = least.join(member, least.fp == member.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    roots = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(roots, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
