"""Exact ranks without one task per group.

``row_number`` over a few large groups would put a whole group in one task.
Here the order key is cut into ranges of about equal row count; a group is
then spread over its ranges, numbered within each, and shifted by the rows
that lie before. One key value shared by many rows is cut further by the hash
of the identifier that orders its rows anyway. The rows are shuffled once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Rows that one window partition may hold.
CELL_ROWS = 1_000_000
#: Ranges of the order key, and sampled rows per range that place them.
MAX_RANGES = 65_536
SAMPLE_ROWS = 50
#: Most partitions that a ranking asks for by itself.
MAX_WIDTH = 32_768


def rank_sorted(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    rows: int,
    name: str = "rn",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add the 1-based rank of every row in its group by columns of any ordered type.

    Above ``cell_rows`` rows the table is written in ranges of (group, order); a
    group of any size lies in neighbouring ranges, and a row's rank is its place in
    its range and the group's rows in the ranges before. Rows that are equal in
    groups and order lie in one range. One shuffle.
    """
    if rows <= cell_rows:
        w = Window.partitionBy(*groups).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    columns = [*groups, *order]
    ranges = min(math.ceil(2 * rows / cell_rows), MAX_WIDTH)
    sorted_ = df.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns)
    at = F.monotonically_increasing_id()
    numbered = materialize(
        sorted_.select("*", F.shiftright(at, 33).alias("__range"), at.bitwiseAND((1 << 33) - 1).alias("__at")), "sorted"
    )
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per group and range that holds rows of it.
    starts = numbered.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    keys = [*groups, "__range"]
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    shifts = starts.select(*[F.col(c).alias(f"__own{i}") for i, c in enumerate(keys)], shift.alias("__shift"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__own{i}")) for i, c in enumerate(keys)])
    rank = (F.col("__at") + F.col("__shift") + 1).cast("bigint").alias(name)
    return numbered.join(shifts, same).select(*[c for c in df.columns if c != name], rank)


def rank_within(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    tie: str,
    rows: int,
    name: str = "rn",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add the 1-based rank of every row in its group by ``(key, tie)``.

    ``key`` is numeric, ``tie`` the hex text from :func:`tie_key`, ``rows`` the
    known row count of ``df``. Null keys come first and NaN last, as a window
    orders them. Up to ``cell_rows`` rows a window is enough, as no group can
    be larger. Beyond ``MAX_RANGES * cell_rows / 2`` rows (3e10 by default) the
    ranges, and with them the cells, grow with the table; raise ``cell_rows``.
    """
    if rows <= cell_rows:
        w = Window.partitionBy(*groups).orderBy(key, tie)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))

    splits, shared = _ranges(df, key, rows, cell_rows)
    as_double = df.withColumn("__cell_key", F.col(key).cast("double"))
    # "keep": NaN gets the range after the last; nulls get one before the first.
    cut = Bucketizer(
        splits=splits, inputCol="__cell_key", outputCol="__cell_range", handleInvalid="keep"
    )
    no_range = [-1.0, float(len(splits) - 1)]
    most = max(1, math.ceil(math.log(max(2 * rows / cell_rows, 2), 16)))
    shared.setdefault(most, []).extend(no_range)
    tie_cell = F.lit("")
    for digits, ranges in shared.items():
        tie_cell = F.when(F.col("__cell_range").isin(ranges), F.substring(tie, 1, digits)).otherwise(
            tie_cell
        )
    placed = cut.transform(as_double).withColumn(
        "__cell_range", F.coalesce("__cell_range", F.lit(-1.0))
    )
    cells = placed.withColumn("__cell_tie", tie_cell).drop("__cell_key")

    cell = [*groups, "__cell_range", "__cell_tie"]
    width = min(math.ceil(rows / cell_rows), MAX_WIDTH)
    if width > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # More partitions than the session's setting, so that one stays small.
        cells = cells.repartition(width, *cell)
    # One row per cell; a group has at most as many as there are ranges.
    before = Window.partitionBy(*groups).orderBy("__cell_range", "__cell_tie").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        cells.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("__cell_rows"))
        .select(*cell, F.coalesce(F.sum("__cell_rows").over(before), F.lit(0)).alias("__cell_before"))
    )
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(key, tie))
    return (
        cells.withColumn("__cell_rank", inside)
        .join(offsets, cell)
        .withColumn(name, (F.col("__cell_before") + F.col("__cell_rank")).cast("bigint"))
        .drop("__cell_range", "__cell_tie", "__cell_rank", "__cell_before")
    )


def _ranges(
    df: DataFrame, key: str, rows: int, cell_rows: int
) -> tuple[list[float], dict[int, list[float]]]:
    """Range bounds of the order key, and the ranges that hold one shared value.

    The latter are listed under the number of leading hex digits of the tie
    key that cut them down to ``cell_rows``.
    """
    parts = min(max(2 * math.ceil(rows / cell_rows), 2), MAX_RANGES)
    probabilities = [i / parts for i in range(1, parts)]
    keys = df.select(F.col(key).cast("double").alias("k"))
    fraction = parts * SAMPLE_ROWS / rows
    if fraction < 1:
        # The bounds decide only how even the ranges are, not the ranks.
        keys = keys.sample(fraction=fraction, seed=1)
    found = keys.approxQuantile("k", probabilities, 1.0 / (4 * parts))
    # A value that fills a whole range shows up at two quantiles or more; it
    # gets a range of its own, [value, next number).
    times = Counter(found)
    repeated = {v: n for v, n in times.items() if n > 1}
    edges = sorted(set(found) | {math.nextafter(v, math.inf) for v in repeated})
    splits = [-math.inf, *(edges or [0.0]), math.inf]
    shared: dict[int, list[float]] = {}
    for i, v in enumerate(splits):
        if v in repeated:
            cells = (repeated[v] + 1) * rows / parts / cell_rows
            digits = max(1, math.ceil(math.log(max(cells, 2), 16)))
            shared.setdefault(digits, []).append(float(i))
    return splits, shared
