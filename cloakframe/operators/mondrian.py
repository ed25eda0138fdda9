"""Mondrian k-anonymity.

Rows are split at the median of the widest standardized dimension, ties by
the hash of the identifier, until a group has at most 2k rows. All groups of
a level advance together.

Large groups are split without moving rows: the median of a group is found by
counting rows in bins of the group's range and zooming into the bin that holds
it, so a level costs a few aggregates. The cuts are a small table that each scan
is decided by; the rows are written again only every few levels (or once the cuts
are too many to broadcast, when they are joined by a shuffle). Once a group fits a
task, the table is shuffled once by group and every task finishes its groups, and
on request their means, on its own.

Group numbers are heap numbers: 1 is the table, 2g and 2g+1 are the halves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tie_key
from ..roles import Roles, project_roles
from ..runtime import discard, materialize, small_side
from .ranking import CELL_ROWS, rank_within
from .stats import Scaling, fit_scaling

#: Bounds of the group size that one task finishes alone; a caller's own number is
#: held to the upper one too, as a task keeps its group in memory.
MIN_LOCAL_ROWS = 200_000
MAX_LOCAL_ROWS = 250_000
#: Bins of one zoom step, and rows that are finally ordered exactly.
BINS = 1024
EXACT_ROWS = 100_000
#: Levels between two copies of the table, and cuts beyond which each level makes one.
REWRITE_LEVELS = 8
REWRITE_GROUPS = 1 << 17
#: Most partitions of the shuffle by group; a partition may hold several groups.
MAX_WIDTH = 32_768


def _zname(i: int) -> str:
    return f"__z{i}"


def _ties(pid: str) -> dict[str, Column]:
    """The tie order as two integers (30 hex digits)."""
    tie = tie_key(F.col(pid))
    return {
        "__t1": F.conv(F.substring(tie, 1, 15), 16, 10).cast("bigint"),
        "__t2": F.conv(F.substring(tie, 16, 15), 16, 10).cast("bigint"),
    }


def mondrian_normalize(df: DataFrame, roles: Roles, scaling: Scaling | None = None) -> DataFrame:
    """Standardize every quasi-identifier by its sample deviation."""
    scaling = scaling or fit_scaling(df, roles.numeric_qis, sample=True)
    return df.withColumns({c: scaling.zscore(c) for c in roles.numeric_qis})


def _widest(dims: Sequence[str]) -> Column:
    """Index of the first dimension with the largest range."""
    ranges = F.array(*[F.col(f"{d}_hi") - F.col(f"{d}_lo") for d in dims])
    return (F.array_position(ranges, F.array_max(ranges)) - 1).cast("int")


def _pick(index: Column, values: Sequence[Column]) -> Column:
    """The value at a row-dependent index, as a chain of comparisons."""
    picked = values[0]
    for i, v in enumerate(values[1:], start=1):
        picked = F.when(index == i, v).otherwise(picked)
    return picked


def _group_ranges(df: DataFrame, dims: Sequence[str], group: str) -> DataFrame:
    """Per group: rows, widest dimension and its bounds."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in dims:
        aggs += [F.min(d).alias(f"{d}_lo"), F.max(d).alias(f"{d}_hi")]
    return (
        df.groupBy(group)
        .agg(*aggs)
        .withColumn("dim", _widest(dims))
        .select(
            group,
            "n",
            "dim",
            _pick(F.col("dim"), [F.col(f"{d}_lo") for d in dims]).alias("lo"),
            _pick(F.col("dim"), [F.col(f"{d}_hi") for d in dims]).alias("hi"),
        )
    )


def rank_in_partition(
    df: DataFrame, roles: Roles, group: str, rows: int, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Rank of every row in its group along the group's widest dimension."""
    dims = list(roles.numeric_qis)
    chosen = _group_ranges(df, dims, group).select(group, "dim")
    keyed = (
        df.join(chosen, group)
        .withColumn("__key", _pick(F.col("dim"), [F.col(d) for d in dims]))
        .withColumn("__tie", tie_key(F.col(roles.pid)))
    )
    return rank_within(keyed, [group], "__key", "__tie", rows, "rn", cell_rows).drop(
        "__key", "__tie"
    )


def _median_cuts(
    rows: DataFrame,
    dims: Sequence[str],
    groups: DataFrame,
    count: int,
    largest: int,
    exact_rows: int,
) -> DataFrame:
    """``(ec, dim, cut, cut_t1, cut_t2)``: the last row of the lower half.

    ``groups`` lists ``ec, n, dim, lo, hi`` of ``count`` groups, the largest of
    which has ``largest`` rows. A search range is a range of the chosen value
    or, within one value, of the tie key.
    """
    search = groups.select(
        "ec",
        "dim",
        "lo",
        "hi",
        F.lit(0).cast("bigint").alias("tlo"),
        F.lit((1 << 60) - 1).cast("bigint").alias("thi"),
        F.expr("n div 2").alias("want"),
        "n",
    )

    def valued(table: DataFrame) -> DataFrame:
        value = _pick(F.col("dim"), [F.col(d) for d in dims])
        return (
            rows.join(small_side(table, count), "ec")
            .withColumn("__v", value)
            .where(
                F.col("__v").between(F.col("lo"), F.col("hi"))
                & F.col("__t1").between(F.col("tlo"), F.col("thi"))
            )
        )

    def bin_of(x: Column, low: Column, high: Column) -> Column:
        place = (x - low).cast("double") / (high - low).cast("double") * F.lit(float(BINS))
        return F.least(F.floor(place), F.lit(BINS - 1))

    while largest > exact_rows:
        spot = F.when(
            F.col("hi") > F.col("lo"), bin_of(F.col("__v"), F.col("lo"), F.col("hi"))
        ).otherwise(
            F.when(
                F.col("thi") > F.col("tlo"), bin_of(F.col("__t1"), F.col("tlo"), F.col("thi"))
            ).otherwise(F.lit(0))
        )
        binned = (
            valued(search)
            .withColumn("bin", spot)
            .groupBy("ec", "dim", "want", "bin")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("__v").alias("lo"),
                F.max("__v").alias("hi"),
                F.min("__t1").alias("tlo"),
                F.max("__t1").alias("thi"),
            )
        )
        # At most BINS rows per group.
        upto = Window.partitionBy("ec").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        search = materialize(
            binned.withColumn("upto", F.sum("n").over(upto))
            .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
            .select(
                "ec",
                "dim",
                "lo",
                "hi",
                "tlo",
                "thi",
                (F.col("want") - (F.col("upto") - F.col("n"))).alias("want"),
                "n",
            ),
            "median",
        )
        divisible = (F.col("hi") > F.col("lo")) | (F.col("thi") > F.col("tlo"))
        largest = search.agg(F.max(F.when(divisible, F.col("n")))).first()[0] or 0
    order = Window.partitionBy("ec").orderBy("__v", "__t1", "__t2")
    return (
        valued(search)
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") == F.col("want"))
        .select(
            "ec",
            "dim",
            F.col("__v").alias("cut"),
            F.col("__t1").alias("cut_t1"),
            F.col("__t2").alias("cut_t2"),
        )
    )


def _split_large(
    rows: DataFrame, dims: Sequence[str], stop: int, exact_rows: int
) -> DataFrame:
    """Split level by level until no group has more than ``stop`` rows.

    The table is written with its standardized values and tie keys first, so
    that the scans of a level read them instead of computing them again. The
    cuts of the levels since then are broadcast and decided anew in each scan;
    every ``REWRITE_LEVELS`` levels (or when the cuts are too many for that)
    the table is written with its groups, and the copy before is removed.
    """
    written = rows = materialize(rows, "standardized")
    level = 0
    while True:
        level += 1
        groups = _group_ranges(rows, dims, "ec").where(F.col("n") > stop)
        groups = materialize(groups, "groups")
        count, largest = groups.agg(F.count(F.lit(1)), F.max("n")).first()
        if not count:
            return rows
        cuts = materialize(
            _median_cuts(rows, dims, groups, count, largest, exact_rows), "cuts"
        )
        value = _pick(F.col("dim"), [F.col(d) for d in dims])
        tie = (F.col("__t1") > F.col("cut_t1")) | (
            (F.col("__t1") == F.col("cut_t1")) & (F.col("__t2") > F.col("cut_t2"))
        )
        above = (value > F.col("cut")) | ((value == F.col("cut")) & tie)
        moved = (
            rows.join(small_side(cuts, count), "ec", "left")
            .withColumn(
                "ec",
                F.when(F.col("cut").isNull(), F.col("ec")).otherwise(
                    F.col("ec") * 2 + above.cast("bigint")
                ),
            )
        )
        rows = moved.select(*rows.columns)
        if level % REWRITE_LEVELS == 0 or count > REWRITE_GROUPS:
            before, written = written, materialize(rows, "halves")
            rows = written
            discard(before)


def _finish_locally(dims: Sequence[str], k: int, recode: Sequence[str] = ()):
    """Split one group down to at most 2k rows per leaf, level by level.

    The columns ``recode`` become the mean of the leaf: the task holds it whole. Texts
    stay Arrow arrays, so that no row's becomes an object of its own.
    """

    def split(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("__t2").to_numpy(), table.column("__t1").to_numpy()))
        values = np.column_stack([table.column(d).to_numpy()[order] for d in dims])
        group = table.column("ec").to_numpy()[order]
        # A row's position in the arrays is its place in tie order, so a stable
        # sort ranks a dimension by (value, tie).
        count = len(order)
        rank = np.empty(values.shape, np.int64)
        for d in range(values.shape[1]):
            rank[np.argsort(values[:, d], kind="stable"), d] = np.arange(count)
        # Rows of the open groups, group by group, and the size of each group.
        rows, sizes = np.arange(count), np.array([count])
        while True:
            open_ = sizes > 2 * k
            rows, sizes = rows[np.repeat(open_, sizes)], sizes[open_]
            if not len(rows):
                break
            first = np.cumsum(sizes) - sizes
            part = values[rows]
            width = np.maximum.reduceat(part, first) - np.minimum.reduceat(part, first)
            number = np.repeat(np.arange(len(sizes)), sizes)
            place = rank[rows, width.argmax(axis=1)[number]]
            rows = rows[np.argsort(number * count + place)]
            half = sizes // 2
            upper = np.arange(len(rows)) - first[number] >= half[number]
            group[rows] = 2 * group[rows] + upper
            sizes = np.column_stack((half, sizes - half)).ravel()
        back = np.empty(count, np.int64)
        back[order] = np.arange(count)
        made = {"ec": group[back]}
        for c in recode:
            own = pd.Series(table.column(c).to_numpy()[order])
            made[c] = own.groupby(group).transform("mean").to_numpy()[back]
        hidden = {"__t1", "__t2", *dims}
        names = [c for c in table.column_names if c not in hidden]
        return pa.table({c: pa.array(made[c]) if c in made else table.column(c) for c in names})

    return split


def mondrian_partition(
    df: DataFrame,
    roles: Roles,
    k: int,
    local_rows: int | None = None,
    exact_rows: int = EXACT_ROWS,
    recode: bool = False,
) -> DataFrame:
    """Role columns of ``df`` with the Mondrian group ``ec``.

    With ``recode`` the numeric quasi-identifiers are the means of the group,
    taken where the group is completed. Every group has k to 2k rows (if the table has k at all). ``local_rows``
    is the group size that one task finishes, ``MAX_LOCAL_ROWS`` at most; by default it
    follows from the table size and the number of cores, within fixed bounds.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    base = project_roles(df, roles)
    scaling = fit_scaling(base, roles.numeric_qis, sample=True, required=roles.columns)
    if local_rows is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        local_rows = min(max(scaling.rows // (4 * cores), MIN_LOCAL_ROWS), MAX_LOCAL_ROWS)
    local_rows = min(local_rows, MAX_LOCAL_ROWS)
    dims = [_zname(i) for i in range(len(roles.numeric_qis))]
    rows = base.withColumns(
        {d: scaling.zscore(c) for d, c in zip(dims, roles.numeric_qis)}
    ).withColumns({"ec": F.lit(1).cast("bigint"), **_ties(roles.pid)})
    if scaling.rows > max(local_rows, 2 * k):
        rows = _split_large(rows, dims, max(local_rows, 2 * k), exact_rows)
    hidden = {*dims, "__t1", "__t2"}
    schema = T.StructType([f for f in rows.schema.fields if f.name not in hidden])
    width = min(2 * scaling.rows // local_rows, MAX_WIDTH)
    if width > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(width, "ec")
    return rows.groupBy("ec").applyInArrow(
        _finish_locally(dims, k, roles.numeric_qis if recode else ()), schema
    )


def mondrian_release(partitioned: DataFrame, roles: Roles, keep_pid: bool = False) -> DataFrame:
    """Group, group means of the quasi-identifiers and the sensitive value.

    A group has at most 2k rows, so a window per group is one small shuffle
    unit and saves the aggregate and the join.
    """
    w = Window.partitionBy("ec")
    means = [F.avg(c).over(w).alias(c) for c in roles.numeric_qis]
    head = [roles.pid] if keep_pid else []
    return partitioned.select("ec", *head, *means, roles.sa)
