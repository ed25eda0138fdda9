"""Running values over ordered groups of any size, without one task per group.

The rows are range-partitioned by (group columns, order columns), so a group that
holds a third of all rows is dealt over many partitions, and written with the
number of their block. A running value (a rank, a sum, the latest row of a kind)
is then the value inside the block, by a window over (group, block), plus what the
group's earlier blocks hand on, which is one small row per group and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import materialize, workers

BLOCK = "_block"
ROW = "_row"


def ordered_blocks(
    df: DataFrame, group: list[str], order: list[str], label: str, arranged: bool = False
) -> DataFrame:
    """``df`` written in ranges of (group, order), with ``_block`` and ``_row``.

    ``_row`` tells rows apart and breaks ties of ``order``: equal rows are ranked
    among each other in any, but a lasting, order. With ``arranged`` a block is
    sorted: ``_row`` is the order, and rows of a group have consecutive numbers.
    """
    n = workers(df)
    # Rows that are equal in all columns are spread by their place in the input.
    spread = F.xxhash64(F.monotonically_increasing_id())
    ranged = df.withColumn("_tie", spread).repartitionByRange(n, *group, *order, "_tie").drop("_tie")
    if arranged:
        ranged = ranged.sortWithinPartitions(*group, *order)
    placed = ranged.withColumn(BLOCK, F.spark_partition_id()).withColumn(ROW, F.monotonically_increasing_id())
    return materialize(placed, label)


def inside(group: list[str], order: list[str]):
    """Window over the rows of a group and block, in order."""
    return Window.partitionBy(*group, BLOCK).orderBy(*order, ROW)


def handed_on(blocks: DataFrame, group: list[str], totals: dict[str, Column], label: str) -> DataFrame:
    """Per (group, block): the sums of ``totals`` over the group's earlier blocks."""
    sums = blocks.groupBy(*group, BLOCK).agg(*[t.alias(n) for n, t in totals.items()])
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *group, BLOCK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )


def attach(blocks: DataFrame, side: DataFrame, group: list[str]) -> DataFrame:
    """Join the one row per (group, block) of ``side``; null groups meet each other."""
    keys = [*group, BLOCK]
    other = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    same = [blocks[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = blocks.join(other, same, "left")
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])
