"""Connected components of an edge table, by alternating stars.

Every round is two joins of the edges with one minimum per node. The minimum is
an aggregate with partial results; it is written, so the join has one row per node
on that side, and a node with very many neighbours is split by the adaptive skew
join. Each
round's edges are written, which cuts the lineage and survives lost executors.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import materialize
from cloakframe.runtime import discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node u to the smallest of them and u.

    ``large``: all larger neighbours; else all smaller ones, and u itself.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.where("v > u").join(materialize(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = moved.union(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of an edge table."""
    mixed = F.xxhash64("u", "v")
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.shiftrightunsigned(mixed, 32)),
            F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))),
        ).first()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root: smallest node reachable.

    Rows with u = v or a null end are no edges. An empty table gives no rows.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(pairs.distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        half = materialize(_star(now, large=True), "edges")
        new = materialize(_star(half, large=False), "edges")
        discard(now, half)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select("node", F.col("node").alias("root"))
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
