"""Aggregates, standardization and distribution distances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import euclidean_norm


def sa_histogram(df: DataFrame, sa: str) -> DataFrame:
    """``(sa, freq, total, p)``: rows and share of every sensitive value."""
    counts = df.groupBy(F.col(sa).cast("string").alias("sa")).agg(
        F.count(F.lit(1)).alias("freq")
    )
    # A scalar subquery: partial sums, no gathered rows.
    total = counts.agg(F.sum("freq")).scalar()
    return counts.withColumn("total", total).withColumn(
        "p", F.col("freq").cast("double") / F.col("total")
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample variance, minimum and maximum: one row per column."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"{c}__mean"),
            F.var_samp(v).alias(f"{c}__variance"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
        ]
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__variance").alias("variance"),
            F.col(f"{c}__min").alias("min"),
            F.col(f"{c}__max").alias("max"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def population_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population variance per column, in one pass."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{c}__mean"), F.var_pop(v).alias(f"{c}__variance")]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__variance").alias("variance"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Scaling:
    """Row count and, per column, mean and standard deviation."""

    rows: int
    mean: dict[str, float]
    spread: dict[str, float]

    def zscore(self, column: str) -> Column:
        """Standardized column; a constant column gives 0."""
        if not self.spread[column]:
            return F.lit(0.0)
        value = F.col(column).cast("double")
        return (value - F.lit(self.mean[column])) / F.lit(self.spread[column])


def fit_scaling(
    df: DataFrame, columns: Sequence[str], sample: bool = False, required: Sequence[str] = ()
) -> Scaling:
    """One aggregate over the table; one row comes back to the driver.

    The numbers then enter later plans as literals, which keeps the row path
    free of joins. ``sample`` chooses the sample standard deviation. A null in
    a ``required`` column is an error, and so is a value of ``columns`` that is
    not finite; both are found in the same pass.
    """
    deviation = F.stddev_samp if sample else F.stddev_pop
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in required]
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"m_{c}"),
            deviation(v).alias(f"s_{c}"),
            (F.min(v) == F.max(v)).alias(f"k_{c}"),
            F.count_if(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).alias(f"f_{c}"),
        ]
    row = df.agg(*aggs).first()
    missing = [c for c in required if row[f"n_{c}"]]
    if missing:
        raise ValueError(f"null values in {missing}")
    endless = [c for c in columns if row[f"f_{c}"]]
    if endless:
        raise ValueError(f"values that are not finite in {endless}")
    spread = {c: 0.0 if row[f"k_{c}"] else (row[f"s_{c}"] or 0.0) for c in columns}
    return Scaling(row["__rows"], {c: row[f"m_{c}"] for c in columns}, spread)


def zscore(df: DataFrame, columns: Sequence[str], scaling: Scaling | None = None) -> DataFrame:
    """Replace ``columns`` by their standardized values."""
    scaling = scaling or fit_scaling(df, columns)
    return df.withColumns({c: scaling.zscore(c) for c in columns})


def qi_norm(
    df: DataFrame, columns: Sequence[str], scaling: Scaling | None = None, name: str = "norm"
) -> DataFrame:
    """Add the L2 norm of the standardized quasi-identifiers."""
    scaling = scaling or fit_scaling(df, columns)
    return df.withColumn(name, euclidean_norm([scaling.zscore(c) for c in columns]))


def ec_sizes(assigned: DataFrame, ec: str = "ec") -> DataFrame:
    return assigned.groupBy(ec).agg(F.count(F.lit(1)).alias("size"))


def ec_means(assigned: DataFrame, columns: Sequence[str], ec: str = "ec") -> DataFrame:
    """Mean of every numeric column per class (partial sums before the shuffle)."""
    return assigned.groupBy(ec).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def ec_ranges(assigned: DataFrame, columns: Sequence[str], ec: str = "ec") -> DataFrame:
    """Minimum and maximum per class and column, and the size of the class."""
    aggs = [F.count(F.lit(1)).alias("size")]
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return assigned.groupBy(ec).agg(*aggs)


def emd(
    df: DataFrame, groups: Sequence[str], order: str, left: str, right: str, name: str = "emd"
) -> DataFrame:
    """Ordered Earth Mover's Distance of two distributions per group.

    ``df`` has one row per (group, category): the sum of the absolute running
    differences in category order, not divided by the number of categories.
    """
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = df.withColumn("__cum", F.sum(F.col(left) - F.col(right)).over(w))
    return running.groupBy(*groups).agg(F.sum(F.abs("__cum")).alias(name))


def kl_divergence(
    df: DataFrame, groups: Sequence[str], left: str, right: str, name: str = "kl"
) -> DataFrame:
    """Sum of p * ln(p / q) per group, p being ``left`` and q ``right``.

    A category with p = 0 adds nothing; one with p > 0 and q = 0 makes the
    distance infinite.
    """
    p, q = F.col(left), F.col(right)
    term = (
        F.when(~(p > 0), F.lit(0.0))
        .when(q > 0, p * F.log(p / q))
        .otherwise(F.lit(float("inf")))
    )
    return df.groupBy(*groups).agg(F.sum(term).alias(name))


def categorical_median(
    assigned: DataFrame, columns: Sequence[str], ec: str = "ec"
) -> DataFrame:
    """Per class and column the value at index ``size div 2`` in sorted order.

    Counts per (class, column, value) come first, so a class of any size is
    reduced to its distinct values before they are ordered.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        assigned.select(ec, F.inline(pairs))
        .groupBy(ec, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(ec, "column")
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.floor(F.sum("n").over(w) / 2)
    found = (
        counts.withColumn("hi", F.sum("n").over(upto))
        .withColumn("mid", middle)
        .where((F.col("mid") < F.col("hi")) & (F.col("mid") >= F.col("hi") - F.col("n")))
    )
    picks = [
        F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns
    ]
    return found.groupBy(ec).agg(*picks)
