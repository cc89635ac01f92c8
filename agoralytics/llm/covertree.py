"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.components import connected_components
from agoralytics.llm.simhash import Forest
from agoralytics.plans.staging import staged

COSINE = 0.9
FIT_SAMPLE = 2048  # vectors among which the centres of cells are chosen
CELL_ROWS = 12_000  # vectors that a cell should be home to
CELLS = 256  # at most; beyond, cells are larger and have more parts
PART_ROWS = 6_000  # vectors of a cell that travel together
LEAF_PAIRS = 1 << 18  # pairs of vectors that are compared at once
TOP_RADIUS = 0.5  # of a part's first level; wider ones are the cells
SLACK = 1e-7  # distances carry rounding; cells this near a bound meet
ROUNDING = 2.0**-24  # of a number in single precision, relative


@dataclass
class Level:
    """Nodes of a tree that share a radius: their centres, covering radii and rows, by covering radius."""

    centres: np.ndarray
    cover: np.ndarray
    members: list[np.ndarray]
    radius: float
    below: dict[int, Level] = field(default_factory=dict)  # levels under the nodes opened so far

    def __post_init__(self):
        self.sizes = np.fromiter(map(len, self.members), dtype=np.int64, count=len(self.members))

    @staticmethod
    def of(rows: np.ndarray, centre: np.ndarray, away: np.ndarray, radius: float) -> Level:
        """The level in which each of ``rows`` lies ``away`` from its ``centre``, which is one of them."""
        centres, owner = np.unique(centre, return_inverse=True)
        cover = np.zeros(len(centres))
        np.maximum.at(cover, owner, np.where(rows == centre, 0.0, away))
        by_cover = np.argsort(cover, kind="stable")
        place = np.empty(len(centres), dtype=int)
        place[by_cover] = np.arange(len(centres))
        order = np.argsort(place[owner], kind="stable")
        edges = np.searchsorted(place[owner][order], np.arange(len(centres) + 1))
        members = [rows[order[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return Level(centres[by_cover], cover[by_cover], members, radius)


class CoverTree:
    """Nested levels of centres with halving radii over unit vectors.

    Every vector lies within a level's radius of its centre there, and centres of a level are
    farther apart than its radius, both in single precision. A node also keeps the distance of its
    farthest vector in double precision, the covering radius that prunes. The ``top`` level is
    found once for a part and given to each tree of it.
    """

    def __init__(self, x: np.ndarray, top: Level | None):
        self.x, self.low, self.top = x, x.astype(np.float32), top

    def centres(self, rows: np.ndarray, radius: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``rows`` its centre among them and how far it is away.

        Blocks of rows are compared with the centres so far; in each block, rows that no centre
        covers become centres one after the other.
        """
        centres = np.empty(0, dtype=int)
        owner = np.empty(len(rows), dtype=int)
        least = 1 - radius * radius / 2  # cosine at the radius
        for k in range(0, len(rows), block):
            part = self.low[rows[k : k + block]]
            best = np.full(len(part), -np.inf, dtype=np.float32)
            own = np.full(len(part), -1)
            for c in range(0, len(centres), 8192):
                cosines = part @ self.low[centres[c : c + 8192]].T
                j = cosines.argmax(axis=1)
                found = cosines[np.arange(len(part)), j]
                own = np.where(found > best, c + j, own)
                best = np.maximum(best, found)
            among = part @ part.T
            fresh = []
            for i in np.flatnonzero(best < least).tolist():
                if best[i] >= least:
                    continue
                closer = among[i] > best
                closer[i] = True
                own[closer], best[closer] = len(centres) + len(fresh), among[i][closer]
                fresh.append(rows[k + i])
            centres = np.concatenate((centres, np.array(fresh, dtype=int)))
            owner[k : k + block] = own
        centre = centres[owner]
        return centre, distance(np.einsum("ij,ij->i", self.x[rows], self.x[centre]))

    def children(self, level: Level, node: int) -> Level:
        """The level under a node, built when the node is first opened."""
        if node not in level.below:
            rows, radius = level.members[node], level.radius / 2
            level.below[node] = Level.of(rows, *self.centres(rows, radius), radius)
        return level.below[node]


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class Links:
    """Counts of linked vectors and what hangs together, gathered without keeping pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, cosine: float):
        self.a, self.b, self.same = a, b, same
        self.weight = weight_a, weight_b
        self.count = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        self.forest = Forest(len(a) if same else len(a) + len(b))
        self.cosine = cosine

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare vectors ``i`` of the first with ``j`` of the second set, a block at a time."""
        step = max(1, LEAF_PAIRS // max(len(j), 1))
        for k in range(0, len(i), step):
            rows = i[k : k + step]
            hit = self.a[rows] @ self.b[j].T >= self.cosine
            if self.same:
                hit &= rows[:, None] != j[None, :]
            p, q = np.nonzero(hit)
            np.add.at(self.count[0], rows[p], self.weight[1][j[q]])
            if not self.same:
                np.add.at(self.count[1], j[q], self.weight[0][rows[p]])
            self.forest.link(rows[p], j[q] + (0 if self.same else len(self.a)))


def open_nodes(left: CoverTree, p: Level, right: CoverTree, q: Level, limit: float) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes of ``p``, each with the nodes of ``q`` that its covering radii and ``limit`` leave open.

    Nodes of ``q`` stand by covering radius, so a few ranges of them share a bound, which one
    comparison of cosines applies to a whole range; what it leaves open is held to its own bound.
    """
    slack = ROUNDING * (left.x.shape[1] + 8)
    ranges = np.unique(np.searchsorted(q.cover, (0.0, q.radius / 4, q.radius / 2, math.inf), side="right"))
    ranges = np.append(0, ranges[ranges > 0])

    def least(reach: np.ndarray) -> np.ndarray:
        return (1 - np.minimum(reach, 2.0) ** 2 / 2 - slack).astype(np.float32)

    for k in range(0, len(p.centres), 256):
        cosines = left.low[p.centres[k : k + 256]] @ right.low[q.centres].T
        cover = limit + p.cover[k : k + 256]
        found = []
        for a, b in zip(ranges[:-1], ranges[1:], strict=True):
            i, j = np.nonzero(cosines[:, a:b] >= least(cover + q.cover[b - 1])[:, None])
            near = cosines[i, a + j] >= least(cover[i] + q.cover[a + j])
            found.append((i[near], a + j[near]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(i, kind="stable")
        nodes, starts = np.unique(i[order], return_index=True)
        edges = np.append(starts, len(order))
        for node, a, b in zip(nodes.tolist(), edges[:-1], edges[1:], strict=True):
            yield k + node, j[order[a:b]]


def traverse(left: CoverTree, right: CoverTree, wx: np.ndarray, wy: np.ndarray, cosine: float) -> Links:
    """All links between the vectors of two trees, or among those of one, by descending both.

    A pair of nodes whose centres are farther apart than both covering radii and the threshold
    allow holds no link and is not opened. Open pairs descend to the children of both nodes
    until few enough pairs of vectors are left to be compared; the vectors of one node are
    compared at once with those of all such nodes beside it, in double precision. Bounds are
    compared in single precision, less what it can lose.
    """
    links = Links(left.x, right.x, wx, wy, left is right, cosine)
    limit = math.sqrt(2 - 2 * cosine)
    stack = [(left.top, right.top)]
    while stack:
        p, q = stack.pop()
        for i, near in open_nodes(left, p, right, q, limit):
            a = p.members[i]
            small = (len(a) * q.sizes[near] <= LEAF_PAIRS) | (p.radius < 1e-3)
            if small.any():
                links.compare(a, np.concatenate([q.members[j] for j in near[small]]))
            for j in near[~small].tolist():
                stack.append((left.children(p, i), right.children(q, j)))
    return links


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; none where a cosine is not defined."""
    if vector is None or not vector or None in vector:
        return None
    v = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _read(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float64).reshape(len(table), -1)


def first_centres(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of each vector in a tree's top level, and how far it is away."""
    return CoverTree(x, None).centres(np.arange(len(x)), TOP_RADIUS)


def _tree(table: pa.Table) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    """The tree of a part whose top level is known, its weights and its nodes."""
    x, node = _read(table), table.column("node").to_numpy()
    order = np.argsort(node)
    centre = order[np.searchsorted(node[order], table.column("centre").to_numpy())]
    top = Level.of(np.arange(len(x)), centre, table.column("off").to_numpy(), TOP_RADIUS)
    return CoverTree(x, top), table.column("weight").to_numpy(), node


def embedding_links(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors link when the cosine of their double-precision values is ``cosine`` or more;
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    ``vec_id`` reachable over links, itself included, and ``kept`` says that it is the row's
    own. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Repeated rows each return and
    link with each other; rows without an id take part and return null ids. An empty table
    gives no rows, other columns are ignored.

    Equal directions become one row with a weight. Cells around centres chosen from a bounded
    sample are the tree's upper level: pairs of cells whose bounds exclude a link never meet.
    Cells are dealt in parts of about ``PART_ROWS``, whose first tree level is found once; each pair
    of parts that may hold links is one group, and descends the trees of both. A group returns one count and at most one link per vector.
    """

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(v) for v in batch.column(1).to_pylist()]
            raw = pa.array([None if u is None else u.tobytes() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["id", "v"])

    read = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = staged(read.mapInArrow(normal, "id bigint, v binary"), "unit-vectors")
    grouped = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    distinct = staged(
        grouped.select("v", "weight", "least", F.monotonically_increasing_id().alias("node")), "distinct-vectors"
    )
    found = staged(_links_of_cells(distinct, cosine), "vector-links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    member = connected_components(edges, "vector-components").withColumnRenamed("node", "n")
    named = distinct.join(member, distinct.node == member.n, "left").select(
        "v", "weight", "least", "node", F.coalesce("component", "node").alias("component")
    )
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(roots, "component").join(counts, "node", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    linked = rows.select("id", "v").join(known, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return linked.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links_of_cells(distinct: DataFrame, cosine: float) -> DataFrame:
    limit = math.sqrt(2 - 2 * cosine) + SLACK
    schema = "node bigint, weight bigint, v binary, dim int, cell int, away double"
    centres: dict[int, np.ndarray] = {}
    for dim, total in distinct.groupBy(F.length("v").alias("dim")).count().collect():
        sample = distinct.where(F.length("v") == dim).orderBy(F.xxhash64("v"), "v").limit(FIT_SAMPLE).select("v")
        centres[dim] = _spread(
            np.array([np.frombuffer(r.v) for r in sample.collect()]), min(CELLS, -(-total // CELL_ROWS))
        )

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.frombuffer(b) for b in batch.column("v").to_pylist()]
            near = [distance(centres[8 * len(x)] @ x) for x in v]
            cell = pa.array([int(d.argmin()) for d in near], pa.int32())
            away = pa.array([float(d.min()) for d in near], pa.float64())
            dim = pa.array([8 * len(x) for x in v], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("node", "weight", "v")] + [dim, cell, away], schema_names
            )

    schema_names = [c.split()[0] for c in schema.split(", ")]
    homes = staged(distinct.select("node", "weight", "v").mapInArrow(home, schema), "cells")
    # At most CELLS rows for each length of vectors, and pairs of these.
    sizes = homes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("cover"))
    cells = [(r.dim, r.cell, -(-r.n // PART_ROWS), r.cover) for r in sizes.orderBy("dim", "cell").collect()]
    spark = distinct.sparkSession

    def top_level(table: pa.Table) -> pa.Table:
        x, node = _read(table), table.column("node").to_numpy()
        centre, off = first_centres(x)
        return table.append_column("centre", pa.array(node[centre])).append_column("off", pa.array(off))

    parts = spark.createDataFrame([c[:3] for c in cells], "dim int, cell int, parts int")
    in_parts = homes.join(parts, ["dim", "cell"]).select(
        "dim", "cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "weight", "v"
    )
    tops = staged(
        in_parts.groupBy("dim", "cell", "part").applyInArrow(
            top_level, "dim int, cell int, part int, node bigint, weight bigint, v binary, centre bigint, off double"
        ),
        "cover-trees",
    )
    meets = []
    for k, (dim, c, of_c, cover) in enumerate(cells):
        for other, d, of_d, reach in cells[k:]:
            apart = distance(centres[dim][c] @ centres[other][d]) if other == dim else math.inf
            if apart <= limit + cover + reach:
                meets.append((dim, c, c, d, of_d, False))
                if c != d:
                    meets.append((dim, d, c, d, of_c, True))
    plan = spark.createDataFrame(
        meets, "dim int, cell int, c int, d int, other_parts int, second boolean"
    )
    part, other = F.col("part"), F.col("other_part")
    first = F.when(F.col("c") == F.col("d"), F.least(part, other)).when(F.col("second"), other).otherwise(part)
    last = F.when(F.col("c") == F.col("d"), F.greatest(part, other)).when(F.col("second"), part).otherwise(other)
    second = F.when(F.col("c") == F.col("d"), part > other).otherwise(F.col("second"))
    dealt = (
        tops.join(plan, ["dim", "cell"])
        .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
        .select("dim", "c", "d", first.alias("p"), last.alias("q"), second.alias("second"), "node", "weight", "v", "centre", "off")
    )

    def links(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy().astype(bool)
        one = {n: table.column(n)[0].as_py() for n in ("c", "d", "p", "q")}
        if (one["c"], one["p"]) != (one["d"], one["q"]):
            (left, wx, a), (right, wy, b) = (_tree(table.filter(pa.array(side))) for side in (~second, second))
            got = traverse(left, right, wx, wy, cosine)
            node, count = np.concatenate((a, b)), np.concatenate(got.count)
        else:
            tree, weight, node = _tree(table)
            got = traverse(tree, tree, weight, weight, cosine)
            count = got.count[0]
        roots = got.forest.roots(np.arange(len(node)))
        hit, moved = np.flatnonzero(count), np.flatnonzero(roots != np.arange(len(node)))
        return pa.table(
            {
                "node": np.concatenate((node[hit], node[moved])),
                "links": pa.array(np.concatenate((count[hit], np.zeros(len(moved), dtype=np.int64)))),
                "other": pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(node[roots[moved]], pa.int64())]),
            }
        )

    return dealt.groupBy("dim", "c", "d", "p", "q").applyInArrow(links, "node bigint, links bigint, other bigint")


def _spread(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres, each the vector farthest from those before, as a cover tree inserts them."""
    chosen = [0]
    away = distance(sample @ sample[0])
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distance(sample @ sample[chosen[-1]]))
    return sample[chosen]
