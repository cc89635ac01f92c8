"""Merkle manifests of tables: trees kept as blocks in van Emde Boas order, proofs read from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.plans.staging import staged

BLOCK_LEVELS = 13  # of a block of 4096 leaves
DIGEST = 32
STEP = DIGEST + 1  # a step of a path: where the sibling stands, and its digest
ALONE, LEFT, RIGHT = 0, 1, 2

_BLOCK = "tree string, block bigint, total bigint, nodes binary, root binary, ids array<bigint>, claimed array<binary>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in hex over the fields: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    listed = []
    for field in fields:
        value = field.cast("string")
        listed.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*listed).cast("binary"), 256)


def tree_key(column: Column) -> Column:
    """A key that sorts like the column bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of the nodes ``index`` at ``depth`` of a tree of ``levels``.

    A tree is its upper half of the levels, then the subtrees below from left to right, each
    laid out by the same rule. So a walk of any length touches few stretches of memory.
    """
    place = np.zeros(len(index), dtype=np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        place += (1 << top) - 1 + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return place


def _hash(*parts: bytes) -> bytes:
    """Digest of digests, which go in as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels_of(total: int, block_levels: int = BLOCK_LEVELS) -> int:
    """Levels of the blocks of a tree of ``total`` leaves: a tree of one block is no higher than it must."""
    return min(block_levels, (total - 1).bit_length() + 1)


def build(leaves: list[bytes], levels: int) -> np.ndarray:
    """All nodes over ``leaves`` as rows of digests in van Emde Boas order; absent nodes are zero."""
    nodes = np.zeros(((1 << levels) - 1, DIGEST), dtype=np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        if depth < levels - 1:
            row = [_hash(*row[k : k + 2]) for k in range(0, len(row), 2)]
        nodes[address(levels, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), dtype=np.uint8).reshape(-1, DIGEST)
    return nodes


def paths(nodes: np.ndarray, levels: int, count: int) -> np.ndarray:
    """For each leaf the steps from it to the root of its block, from the bottom."""
    steps = np.zeros((count, levels - 1, STEP), dtype=np.uint8)
    index, width = np.arange(count), count
    for k, depth in enumerate(range(levels - 1, 0, -1)):
        sibling = index ^ 1
        present = sibling < width
        steps[present, k, 0] = np.where(sibling < index, LEFT, RIGHT)[present]
        steps[present, k, 1:] = nodes[address(levels, depth, sibling[present])]
        index, width = index >> 1, (width + 1) >> 1
    return steps.reshape(count, -1)


def fold(digest: bytes, path: bytes) -> tuple[bytes, str]:
    """The root that a leaf and its path give, and the digest of the siblings on it."""
    siblings = []
    for k in range(0, len(path), STEP):
        side, other = path[k], path[k + 1 : k + STEP]
        if side == ALONE:
            digest = _hash(digest)
            continue
        siblings.append(other.hex())
        digest = _hash(other, digest) if side == LEFT else _hash(digest, other)
    return digest, hashlib.sha256("".join(siblings).encode()).hexdigest()


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the ``position`` in their tree, in ``order``, and the tree's ``total``.

    Rows are sorted by range and written; a tree's start in each sorted part comes from counts
    per tree and part, and joins by both, so a tree that holds most rows is spread over parts.
    Equal rows are told apart by where they were read, and so are spread as well.
    """
    read = rows.withColumn("read", F.monotonically_increasing_id())
    ordered = staged(read.orderBy("tree", *order, "read").withColumn("slot", F.monotonically_increasing_id()), "manifest-leaves")
    ordered = ordered.withColumn("part", F.shiftright("slot", 33))
    counted = ordered.groupBy("tree", "part").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"))
    one_tree = Window.partitionBy("tree")
    starts = counted.select(
        "tree",
        "part",
        (F.sum("n").over(one_tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(one_tree).alias("total"),
    )
    placed = ordered.join(starts, ["tree", "part"])
    return placed.withColumn("position", F.col("slot") + F.col("shift")).drop("read", "slot", "part", "shift")


def _blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    """Blocks of neighbouring nodes ``(tree, position, total, doc_id, digest, claimed)``, each with all above them."""

    def block(table: pa.Table) -> pa.Table:
        rows = table.sort_by("position").select(["doc_id", "digest", "claimed"])
        total = table.column("total")[0].as_py()
        tree = build(rows.column("digest").to_pylist(), levels_of(total, block_levels))
        return pa.table(
            {
                "tree": table.column("tree").slice(0, 1),
                "block": table.column("block").slice(0, 1),
                "total": table.column("total").slice(0, 1),
                "nodes": pa.array([tree.tobytes()], pa.binary()),
                "root": pa.array([tree[0].tobytes()], pa.binary()),
                "ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "claimed": pa.array([rows.column("claimed").to_pylist()], pa.list_(pa.binary())),
            }
        )

    leaves = 1 << (block_levels - 1)
    dealt = nodes.withColumn("block", F.floor(F.col("position") / leaves).cast("bigint"))
    return dealt.groupBy("tree", "block").applyInArrow(block, _BLOCK)


def _tiers(leaves: DataFrame, block_levels: int) -> list[DataFrame]:
    """Written blocks of all trees from the leaves up: the roots of a tier's blocks are the leaves of the next."""
    width = leaves.agg(F.max("total").alias("n")).first().n or 0
    size = 1 << (block_levels - 1)
    tiers = [staged(_blocks(leaves, block_levels), "manifest-blocks")]
    while width > size:
        above = tiers[-1].where(F.col("total") > size).select(
            "tree",
            F.col("block").alias("position"),
            F.ceil(F.col("total") / size).cast("bigint").alias("total"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.col("root").alias("digest"),
            F.lit(None).cast("binary").alias("claimed"),
        )
        tiers.append(staged(_blocks(above, block_levels), "manifest-blocks"))
        width = -(-width // size)
    return tiers


def _roots(tiers: list[DataFrame], block_levels: int) -> DataFrame:
    """The root of every tree: that of the one block of its last tier."""
    found = [t.where(F.col("total") <= 1 << (block_levels - 1)).select("tree", "root") for t in tiers]
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]


def _unpacked(row: dict, block_levels: int) -> tuple[np.ndarray, int, int]:
    """A block's nodes, its levels and its number of leaves."""
    size, total = 1 << (block_levels - 1), row["total"]
    nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
    return nodes, levels_of(total, block_levels), min(size, total - row["block"] * size)


def _leaf_paths(known: DataFrame, block_levels: int) -> DataFrame:
    """``tree, position, path, subroot`` of every leaf of blocks that know what follows after their root."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            nodes, levels, count = _unpacked(row, block_levels)
            first = row["block"] << (block_levels - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * count, pa.string()),
                    pa.array(np.arange(first, first + count)),
                    pa.array([s.tobytes() + row["path"] for s in paths(nodes, levels, count)], pa.binary()),
                    pa.array([row["subroot"]] * count, pa.binary()),
                ],
                ["tree", "position", "path", "subroot"],
            )

    return known.drop("ids", "claimed", "root").mapInArrow(each, "tree string, position bigint, path binary, subroot binary")


def _with_paths(tiers: list[DataFrame], ends: DataFrame, block_levels: int) -> DataFrame:
    """The blocks of the lowest tier, each with the path that goes on from its root.

    ``ends(tree, path, subroot)`` is what follows after a tree's root. From the top tier down, a
    block hands every leaf its steps and what follows after itself; those are the paths of the
    blocks of the tier below.
    """
    size = 1 << (block_levels - 1)
    found = None
    for k in range(len(tiers) - 1, -1, -1):
        known = tiers[k].where(F.col("total") <= size).join(ends, "tree")
        if found is not None:
            below = found.withColumnRenamed("position", "block")
            known = known.unionByName(tiers[k].where(F.col("total") > size).join(below, ["tree", "block"]))
        if k:
            found = staged(_leaf_paths(known, block_levels), "manifest-paths")
    return known


def prove(rows: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Build the manifest of ``rows`` and verify each row's claimed leaf against its root.

    ``rows`` has ``tree`` (string, by :func:`tree_key`), ``doc_id``, ``leaf`` (hex) and ``claimed``
    (hex, null: the leaf itself); other columns are ignored. In a tree leaves ascend by id, rows
    without an id first, rows of one id by leaf. While several nodes remain, every two neighbours
    become one (a last single one becomes its own digest); the trees' roots, in the order of the
    keys, give the root likewise. Returns for every row ``doc_id, leaf, subroot, root,
    proof_sha256`` (digest of the siblings from the leaf to the root), ``folded_root`` (from the
    claimed leaf and those siblings) and ``verified``. Repeated rows each return; an empty table
    gives no rows.

    Blocks of aligned subtrees are built and written in van Emde Boas order; their roots are
    the leaves of a tier of blocks above, until every tree has one block. A path is read from
    the blocks by address, tier by tier. No task holds more than a block.
    """
    leaves = rows.select(
        F.col("tree").cast("string").alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex("leaf").alias("digest"),
        F.unhex("claimed").alias("claimed"),
    )
    tiers = _tiers(_placed(leaves, ["doc_id", "digest"]), block_levels)
    subroots = _roots(tiers, block_levels).select(F.col("tree").alias("key"), F.col("root").alias("subroot"))
    nothing = F.lit(None)
    tops = _placed(
        subroots.select(
            F.lit("").alias("tree"),
            "key",
            nothing.cast("bigint").alias("doc_id"),
            F.col("subroot").alias("digest"),
            nothing.cast("binary").alias("claimed"),
        ),
        ["key"],
    )
    top_tiers = _tiers(tops, block_levels)
    top = _roots(top_tiers, block_levels).first()
    root = bytes(top.root) if top else b""
    start = rows.sparkSession.range(1).select(
        F.lit("").alias("tree"), F.lit(b"").alias("path"), nothing.cast("binary").alias("subroot")
    )
    after = _leaf_paths(_with_paths(top_tiers, start, block_levels), block_levels).drop("tree", "subroot")
    ends = staged(
        tops.join(after, "position").select(F.col("key").alias("tree"), "path", F.col("digest").alias("subroot")), "manifest-ends"
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            nodes, levels, count = _unpacked(row, block_levels)
            digests = nodes[address(levels, levels - 1, np.arange(count))]
            out = []
            for doc, digest, claimed, steps in zip(row["ids"], digests, row["claimed"], paths(nodes, levels, count), strict=True):
                leaf = digest.tobytes()
                folded, proof = fold(claimed or leaf, steps.tobytes() + row["path"])
                out.append((doc, leaf.hex(), row["subroot"].hex(), root.hex(), proof, folded.hex(), folded == root))
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return _with_paths(tiers, ends, block_levels).drop("root").mapInArrow(
        verified,
        "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
