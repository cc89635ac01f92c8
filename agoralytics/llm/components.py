"""Connected components of a link table, as rounds of joins over staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.plans.staging import staged

MAX_ROUNDS = 64


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _smaller(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges(a, b)`` → ``(node, component)``: the smallest node reachable, for every node with a link.

    Alternates two contractions until nothing changes: every node's larger neighbours are
    linked to its smallest neighbour, then every node's smaller neighbours are. Each keeps the
    components and never adds edges, so a hub's links are only re-pointed. The minimum per node
    is a partial aggregate, and the join that follows has a skewed side that adaptive execution
    may split. Each round is written to the shared folder, which cuts the lineage. Self links
    and repeats are allowed; links with a null end are ignored.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = staged(
        edges.select(F.greatest("a", "b").alias("a"), _smaller("a", "b").alias("b")).distinct(),
        label,
    )
    before = None
    for _ in range(MAX_ROUNDS):
        large = _contract(_both_ways(current), larger=True)
        current = staged(_contract(large, larger=False), label)
        # The same edges twice in a row are the fixed point: a star per component.
        digest = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _contract(links: DataFrame, larger: bool) -> DataFrame:
    """Point each node's larger (or its smaller) neighbours, and for the latter itself, to the smallest."""
    if not larger:
        links = links.select(F.greatest("a", "b").alias("a"), _smaller("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("n"), _smaller("a", "m").alias("m")
    )
    joined = links.join(least, links.a == least.n)
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()
