"""Audits of an assigned table: information loss and skewness."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, small_side
from .ranking import CELL_ROWS, rank_within
from .stats import ec_ranges
from .taxonomy import generalize_to_level


def ec_range_report(assigned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per class: size and the range of every column."""
    ranges = ec_ranges(assigned, columns)
    return ranges.select(
        "ec", "size", *[(F.col(f"{c}_max") - F.col(f"{c}_min")).alias(f"{c}_range") for c in columns]
    )


def information_loss(assigned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum over classes and columns of (class range / table range) * class size.

    The table range is a constant of the sum, so class ranges, table ranges
    and the sum are one aggregate over the classes. A constant column adds 0.
    ``normalized`` divides by rows and columns.
    """
    ranges = ec_ranges(assigned, columns)
    aggs = [F.sum("size").alias("rows")]
    for c in columns:
        width = F.col(f"{c}_max") - F.col(f"{c}_min")
        aggs += [
            F.sum(width * F.col("size")).alias(f"w_{c}"),
            (F.max(f"{c}_max") - F.min(f"{c}_min")).alias(f"g_{c}"),
        ]
    total = F.lit(0.0)
    for c in columns:
        total = total + F.when(
            F.col(f"g_{c}") > 0, F.col(f"w_{c}") / F.col(f"g_{c}")
        ).otherwise(F.lit(0.0))
    return (
        ranges.agg(*aggs)
        .withColumn("information_loss", total)
        .select(
            "information_loss",
            (F.col("information_loss") / (F.col("rows") * F.lit(float(len(columns))))).alias(
                "normalized"
            ),
        )
    )


def class_value_counts(
    assigned: DataFrame,
    sa: str,
    paths: DataFrame | None = None,
    level: int | None = None,
    height: int | None = None,
) -> DataFrame:
    """``(ec, value, n)``, the value rolled up to a taxonomy level if given.

    The roll-up runs on the counts, not on the rows.
    """
    counts = assigned.groupBy("ec", F.col(sa).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if level is None or level == height:
        return counts
    rolled = generalize_to_level(counts, "value", paths, level, height, "__up")
    return rolled.groupBy("ec", F.col("__up").alias("value")).agg(F.sum("n").alias("n"))


def skew_per_sa(counts: DataFrame) -> DataFrame:
    """Percent change of every value's share in a class against the table.

    ``counts`` comes from :func:`class_value_counts`; only values present in
    the class are reported.
    """
    # As small as the histogram of the sensitive attribute: written, so that its size
    # is known, and joined to the classes without a shuffle on its few values.
    table = materialize(counts.groupBy("value").agg(F.sum("n").alias("__all")), "table-counts")
    values, rows = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("__all"), F.lit(0))).first()
    shares = table.select("value", (F.col("__all") / F.lit(rows)).alias("p_table"))
    in_class = counts.withColumn(
        "p_class", F.col("n") / F.sum("n").over(Window.partitionBy("ec"))
    )
    change = F.abs(F.col("p_table") - F.col("p_class")) / F.col("p_table") * F.lit(100.0)
    return in_class.join(small_side(shares, values), "value").select(
        "ec", "value", "p_table", "p_class", change.alias("change")
    )


def skew_per_ec(skew: DataFrame) -> DataFrame:
    """Average and largest change per class."""
    return skew.groupBy("ec").agg(
        F.avg("change").alias("avg_change"), F.max("change").alias("max_change")
    )


def skew_dataset(per_ec: DataFrame) -> DataFrame:
    """Mean of the class averages, largest change, number of classes."""
    return per_ec.agg(
        F.avg("avg_change").alias("avg_change"),
        F.max("max_change").alias("max_change"),
        F.count(F.lit(1)).alias("classes"),
    )


def worst_class(skew: DataFrame) -> DataFrame:
    """The class and value with the largest change."""
    return skew.orderBy(F.desc("change"), "ec", "value").limit(1)


def classes_by_size(assigned: DataFrame) -> DataFrame:
    """Classes from largest to smallest."""
    return (
        assigned.groupBy("ec")
        .agg(F.count(F.lit(1)).alias("size"))
        .orderBy(F.desc("size"), "ec")
    )


def cap_excess(skew: DataFrame, beta: float) -> DataFrame:
    """Values whose share in a class passes their own likeness cap.

    With overlapping buckets the cap bounds a bucket, not a value; this lists
    where the two differ.
    """
    from ..functions import hundredths, likeness_cap

    cap = likeness_cap(F.col("p_table"), beta)
    return skew.where(hundredths(F.col("p_class")) > hundredths(cap)).select(
        "ec", "value", "p_class", cap.alias("cap")
    )


#: Values whose running shares are broadcast at once.
PART_VALUES = 1 << 21


def _distance_in(shares, first: int):
    """Sum of |c - share| over the values a to b that lie in one part.

    ``shares`` holds the part's running shares, which rise; those up to c count
    c - share, the others share - c.
    """

    @F.pandas_udf("double")
    def add(c: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rising = shares.value
        summed = np.concatenate([[0.0], np.cumsum(rising)])
        low = np.clip(a.to_numpy() - first, 0, len(rising))
        high = np.clip(b.to_numpy() - first + 1, low, len(rising))
        level = c.to_numpy()
        turn = np.clip(np.searchsorted(rising, level, "right"), low, high)
        under = level * (turn - low) - (summed[turn] - summed[low])
        over = (summed[high] - summed[turn]) - level * (high - turn)
        return pd.Series(under + over)

    return add


def emd_per_class(
    counts: DataFrame,
    normalize: bool = False,
    part_values: int = PART_VALUES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Ordered Earth Mover's Distance of every class to the table.

    Values are ordered by name. Between two values that a class holds, its own
    running share stands still and the table's rises, so a class costs one
    step per value it holds; the grid of classes and values is never built.
    The table's running shares are broadcast in parts of ``part_values``.
    """
    table = materialize(counts.groupBy("value").agg(F.sum("n").alias("n")), "table-counts")
    values, rows = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    keyed = table.withColumns({"__zero": F.lit(0), "__tie": F.hex(F.col("value").cast("binary"))})
    ranked = rank_within(keyed, [], "__zero", "__tie", values, "__at", cell_rows)
    ranked = materialize(ranked.select("value", "n", "__at"), "ranked-values")

    # One step per held value, and one before the first.
    held = counts.join(small_side(ranked.select("value", "__at"), values), "value")
    here = held.select("ec", "__at", F.col("n").cast("double").alias("__n"))
    start = counts.select("ec").distinct().select(
        "ec", F.lit(1).cast("bigint").alias("__at"), F.lit(0.0).alias("__n")
    )
    # A class that holds the first value has two rows there: one step of length 0.
    w = Window.partitionBy("ec").orderBy("__at", "__n")
    whole = F.sum("__n").over(Window.partitionBy("ec"))
    steps = here.unionByName(start).select(
        "ec",
        (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / whole).alias("__c"),
        F.col("__at").alias("__a"),
        (F.coalesce(F.lead("__at").over(w), F.lit((values or 0) + 1)) - 1).alias("__b"),
    )
    total, cumulative = F.lit(0.0), 0
    for first in range(1, (values or 0) + 1, part_values):
        inside = F.col("__at").between(first, first + part_values - 1)
        part = ranked.where(inside).orderBy("__at").select("n").toPandas()["n"].to_numpy()
        running = cumulative + np.cumsum(part)
        cumulative = int(running[-1])
        shares = counts.sparkSession.sparkContext.broadcast(running / rows)
        total = total + _distance_in(shares, first)("__c", "__a", "__b")
    if normalize:
        total = total / F.lit(float(max((values or 0) - 1, 1)))
    return steps.select("ec", total.alias("emd")).groupBy("ec").agg(F.sum("emd").alias("emd"))
