"""Redistribution: rows to classes.

Rows of a bucket are ordered by the norm of their standardized
quasi-identifiers, the seats of the bucket by class size; row n takes seat n.
The seats are never listed: the n-th row falls into one of a few runs of
equally large classes, and its class follows by a division.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import class_id, euclidean_norm, order_key, tie_key
from ..roles import Roles
from ..runtime import materialize, small_side
from .ranking import CELL_ROWS, rank_within
from .stats import Scaling, fit_scaling


def with_norm_key(df: DataFrame, roles: Roles, scaling: Scaling) -> DataFrame:
    """Add ``__key`` (quantized norm) and ``__tie`` (hash of the identifier)."""
    norm = euclidean_norm([scaling.zscore(c) for c in roles.numeric_qis])
    return df.withColumns({"__key": order_key(norm), "__tie": tie_key(F.col(roles.pid))})


def bucket_quotas(plan: DataFrame) -> DataFrame:
    """Per value, the interval of its ranks that belongs to each bucket."""
    w = Window.partitionBy("threshold", "sa").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return plan.withColumn("hi", F.sum("quota").over(w)).select(
        "threshold",
        "bucket",
        "sa",
        (F.col("hi") - F.col("quota")).alias("lo"),
        "hi",
        F.count(F.lit(1)).over(Window.partitionBy("threshold", "sa")).alias("shares"),
    )


def join_bucket(df: DataFrame, roles: Roles, plan: DataFrame, plan_rows: int) -> DataFrame:
    """Rows joined with the buckets of their value; values in several buckets
    give several rows."""
    look = plan.select(F.col("sa").alias(roles.sa), "bucket", "quota")
    return df.join(small_side(look, plan_rows), roles.sa)


@dataclass(frozen=True)
class PlanSize:
    """Rows of a bucket plan and number of its values."""

    rows: int
    values: int

    @staticmethod
    def of(plan: DataFrame) -> PlanSize:
        return PlanSize(*plan.agg(F.count(F.lit(1)), F.countDistinct("sa")).first())


def dedup_overlap(
    df: DataFrame, roles: Roles, plan: DataFrame, size: PlanSize, rows: int, cell_rows: int
) -> DataFrame:
    """Give every row exactly one bucket.

    A value in one bucket is a look-up. Only rows whose value is shared by
    several buckets are ranked, and each bucket takes the interval of ranks
    that its quota gives it. ``df`` carries ``__key`` and ``__tie``.
    """
    if size.rows == size.values:
        return join_bucket(df, roles, plan, size.rows).drop("quota")
    quotas = bucket_quotas(plan).withColumnRenamed("sa", roles.sa)
    single = quotas.where(F.col("shares") == 1).select(roles.sa, "bucket")
    alone = df.join(small_side(single, size.rows), roles.sa)
    split = quotas.where(F.col("shares") > 1).select(roles.sa, "bucket", "lo", "hi")
    values = split.select(roles.sa).distinct()
    contested = df.join(small_side(values, size.rows), roles.sa, "left_semi")
    ranked = rank_within(contested, [roles.sa], "__key", "__tie", rows, "__rank", cell_rows)
    placed = (
        ranked.join(small_side(split, size.rows), roles.sa)
        .where((F.col("__rank") > F.col("lo")) & (F.col("__rank") <= F.col("hi")))
        .drop("__rank", "lo", "hi")
    )
    return alone.unionByName(placed)


def rank_rows(
    df: DataFrame,
    roles: Roles,
    plan: DataFrame,
    scaling: Scaling | None = None,
    cell_rows: int = CELL_ROWS,
    size: PlanSize | None = None,
) -> DataFrame:
    """Rows with their ``bucket`` and 1-based rank ``rn`` in it, by norm."""
    scaling = scaling or fit_scaling(df, roles.numeric_qis)
    size = size or PlanSize.of(plan)
    keyed = with_norm_key(df, roles, scaling)
    if scaling.rows > cell_rows:
        # Sampled, counted and ranked: written once, not evaluated for each.
        keyed = materialize(keyed, "keyed")
    placed = dedup_overlap(keyed, roles, plan, size, scaling.rows, cell_rows)
    return rank_within(placed, ["bucket"], "__key", "__tie", scaling.rows, "rn", cell_rows)


def join_seat(ranked: DataFrame, runs: DataFrame, runs_rows: int) -> DataFrame:
    """Ranked rows joined with the run of seats that covers their rank."""
    look = runs.select(
        F.col("bucket").alias("__bucket"),
        "size",
        F.col("level").alias("ec_level"),
        "first_seq",
        "row_lo",
        (F.col("row_lo") + F.col("size") * F.col("classes")).alias("row_hi"),
    )
    at = F.col("rn") - 1
    joined = ranked.join(
        small_side(look, runs_rows),
        (F.col("bucket") == F.col("__bucket"))
        & (at >= F.col("row_lo"))
        & (at < F.col("row_hi")),
    )
    seq = F.col("first_seq") + F.expr("(rn - 1 - row_lo) div size")
    return (
        joined.withColumn("ec_seq", seq)
        .withColumn("ec", class_id(F.col("ec_level"), F.col("ec_seq")))
        .drop("__bucket", "size", "first_seq", "row_lo", "row_hi")
    )


def redistribute_by_norm(
    df: DataFrame,
    roles: Roles,
    plan: DataFrame,
    runs: DataFrame,
    levels: int,
    scaling: Scaling | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Rows with their class ``ec`` (and ``bucket``); columns are carried
    through, so no join back to the table is needed. ``levels`` is the number
    of tree levels with classes; a bucket has at most two runs in each."""
    size = PlanSize.of(plan)
    ranked = rank_rows(df, roles, plan, scaling, cell_rows, size)
    seated = join_seat(ranked, runs, 2 * levels * size.rows)
    return seated.drop("__key", "__tie", "rn", "ec_level", "ec_seq")
