"""Bucketization: from the histogram of the sensitive attribute to buckets.

All three methods take a list of thresholds and keep the threshold as a
grouping column, so a sweep over many thresholds is one job on one histogram.
Every plan has the long form

    threshold, bucket, sa, quota, freq, cap

with one row per bucket and sensitive value: ``quota`` rows of value ``sa``
belong to ``bucket``, which has ``freq`` rows and the upper bound ``cap``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import likeness_cap
from ..runtime import materialize, small_side
from .ranking import CELL_ROWS, rank_sorted, rank_within

PLAN_COLUMNS = ["threshold", "bucket", "sa", "quota", "freq", "cap"]


def _per_threshold(df: DataFrame, limits: Sequence[float]) -> DataFrame:
    """One copy of the rows per threshold."""
    if not limits or min(limits) <= 0:
        raise ValueError("thresholds must be positive")
    listed = F.array(*[F.lit(float(v)) for v in limits])
    return df.select("*", F.explode(listed).alias("threshold"))


def _with_caps(histogram: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Histogram per threshold, with the likeness cap of every value."""
    return _per_threshold(histogram, limits).withColumn(
        "cap", likeness_cap(F.col("p"), F.col("threshold"))
    )


def number_buckets(buckets: DataFrame, rows: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Give whole buckets (``threshold, items, freq, cap``) their numbers.

    The number is the rank of the sorted value list, which is also the
    category order of the Earth Mover's Distance. ``rows`` is the most that
    there are; above ``cell_rows`` they are ranked in ranges.
    """
    names = F.transform("items", lambda x: x["sa"])
    named = buckets.withColumn("__names", names)
    order = ["__names", "freq", "items", "cap"]
    return rank_sorted(named, ["threshold"], order, rows, "bucket", cell_rows).drop("__names")


def explode_buckets(numbered: DataFrame) -> DataFrame:
    """One row per (bucket, sensitive value)."""
    return numbered.select(
        "threshold", "bucket", F.inline("items").alias("sa", "quota"), "freq", "cap"
    )


def nonempty_buckets(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("freq") > 0)


def bucket_dedup(plan: DataFrame) -> DataFrame:
    """One row per bucket: number, size and cap."""
    return plan.groupBy("threshold", "bucket").agg(
        F.max("freq").alias("freq"), F.max("cap").alias("cap")
    )


def sort_by_cap(histogram: DataFrame, beta: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Position of every sensitive value in cap order, ties by the value.

    The cap grows with the share, so ordering by the count gives the same
    order without comparing floating-point numbers.
    """
    # The hex digits of a text order as the text does.
    keyed = histogram.withColumn("__tie", F.hex(F.col("sa").cast("binary")))
    ranked = rank_within(keyed, [], "freq", "__tie", histogram.count(), "position", cell_rows)
    return ranked.select("sa", "freq", likeness_cap(F.col("p"), beta).alias("cap"), "position")


# --------------------------------------------------------------------------
# beta-likeness


def _fill_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """Buckets of the values of one threshold, by runs of values with equal counts.

    A row is a run: ``values`` values with share ``p`` and ``cap`` each. It tops up the
    open bucket, value by value, and then fills buckets of its own, which are all
    alike. A bucket holds at most 1 - ln(share of its first value) values, so a
    run takes a few steps, whatever its length, and sums are those of a walk over
    the single values. Given out are pieces of runs: the values with rank ``lo`` <
    rank <= ``hi`` fill buckets from number ``opened`` on, ``each`` in one.
    """
    opened, share, room = 0, 0.0, float("inf")
    pieces = []
    for threshold, freq, p, cap, values in runs.sort_values("freq").itertuples(index=False):
        placed = 0
        while placed < values and share + p <= min(room, cap):
            share, room, placed = share + p, min(room, cap), placed + 1
        if placed:
            pieces.append((threshold, freq, 0, placed, opened, placed))
        left = values - placed
        if not left:
            continue
        each, held = 1, p
        while each < left and held + p <= cap:
            each, held = each + 1, held + p
        pieces.append((threshold, freq, placed, values, opened + 1, each))
        opened += -(-left // each)
        share, room = 0.0, cap
        for _ in range((left - 1) % each + 1):
            share += p
    return pd.DataFrame(pieces, columns=["threshold", "freq", "lo", "hi", "opened", "each"])


def beta_buckets(histogram: DataFrame, limits: Sequence[float], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Greedy fill in cap order; a value that does not fit opens a new bucket.

    Whether a value fits depends on all before it, but values with equal counts
    have equal caps. So only the distinct counts are walked, at most sqrt(2 N) of
    them for N rows (:func:`_fill_runs`); a value finds its bucket by its rank
    among the values of its count.
    """
    counts = histogram.groupBy("freq").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("values"))
    runs = _with_caps(counts, limits).select("threshold", "freq", "p", "cap", "values")
    pieces = materialize(
        runs.groupBy("threshold").applyInPandas(
            _fill_runs, "threshold double, freq bigint, lo bigint, hi bigint, opened bigint, each bigint"
        ),
        "pieces",
    )
    rows = histogram.count()
    ranked = rank_sorted(histogram.select("sa", "freq", "p"), ["freq"], ["sa"], rows, "__rank", cell_rows)
    placed = ranked.join(small_side(pieces, pieces.count(), 64), "freq").where(
        (F.col("__rank") > F.col("lo")) & (F.col("__rank") <= F.col("hi"))
    )
    opened = F.col("opened") + F.expr("(__rank - lo - 1) div each")
    filled = placed.select("threshold", "sa", "freq", opened.alias("opened"), likeness_cap(F.col("p"), F.col("threshold")).alias("cap"))
    buckets = filled.groupBy("threshold", "opened").agg(
        F.array_sort(F.collect_list(F.struct("sa", F.col("freq").alias("n")))).alias("items"),
        F.sum("freq").alias("freq"),
        F.min("cap").alias("cap"),  # of the first value: caps rise with the count
    )
    numbered = number_buckets(buckets.drop("opened"), rows * len(limits), cell_rows)
    return explode_buckets(numbered).select(*PLAN_COLUMNS)


# --------------------------------------------------------------------------
# t-closeness


def hierarchy_cost(histogram: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """``(sa, level, node, cost)``: cost of keeping the values under a node together.

    At level L the node is the L-th ancestor of the value; its cost adds, over
    its children, (L / height) * (sum of shares - smallest share).
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")
    up = paths.select(F.col("node").alias("sa"), "path")
    placed = (
        histogram.join(up, "sa")
        .select("sa", "p", "path", levels)
        .select(
            "sa",
            "p",
            "level",
            F.get("path", F.greatest("level", F.lit(1))).alias("node"),
            F.get("path", F.greatest(F.col("level") - 1, F.lit(1))).alias("below"),
        )
    )
    per_child = placed.groupBy("level", "node", "below").agg(
        F.sum("p").alias("s"), F.min("p").alias("m")
    )
    weight = F.col("level").cast("double") / F.lit(float(height))
    cost = per_child.groupBy("level", "node").agg(
        F.sum(weight * (F.col("s") - F.col("m"))).alias("cost")
    )
    return placed.select("sa", "level", "node").join(cost, ["level", "node"])


def frontier_at(histogram: DataFrame, paths: DataFrame, height: int, level: int, t: float):
    """Values still to be split below ``level``, joined with their counts."""
    open_ = hierarchy_cost(histogram, paths, height).where(
        (F.col("level") >= level) & (F.col("cost") >= t)
    )
    seen = open_.groupBy("sa").agg(F.count(F.lit(1)).alias("levels"))
    waiting = seen.where(F.col("levels") == height - level + 1).select("sa")
    return waiting.join(histogram.select("sa", "freq", "p"), "sa")


def tclose_buckets(
    histogram: DataFrame, limits: Sequence[float], paths: DataFrame, height: int
) -> DataFrame:
    """Highest taxonomy nodes whose cost stays below the threshold.

    The cost of every (node, level) does not depend on the threshold, so one
    pass serves all of them; a value takes its highest admissible node.
    """
    cost = hierarchy_cost(histogram, paths, height)
    chosen = (
        _per_threshold(cost, limits)
        .where(F.col("cost") < F.col("threshold"))
        .groupBy("threshold", "sa")
        .agg(F.max(F.struct("level", "node", "cost")).alias("at"))
    )
    buckets = (
        chosen.join(histogram.select("sa", "freq"), "sa")
        .groupBy("threshold", "at")
        .agg(
            F.array_sort(F.collect_list(F.struct("sa", F.col("freq").alias("n")))).alias("items"),
            F.sum("freq").alias("freq"),
        )
        .select("threshold", "items", "freq", F.col("at.cost").alias("cap"))
    )
    return explode_buckets(number_buckets(buckets)).select(*PLAN_COLUMNS)


# --------------------------------------------------------------------------
# overlapping buckets

_ROUND_SCHEMA = (
    "threshold double, total bigint, item string, sa string, n bigint, cap double, done boolean"
)


def _cap(freq: int, total: int, beta: float) -> float:
    share = freq / total
    return (1.0 + min(beta, -np.log(share))) * share


def _fill_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One round for one taxonomy node: merge its items into buckets.

    Rows are (item, value, n); an item that overflows the open bucket is cut,
    the first rows of its values topping up the bucket. ``key`` is the
    threshold and the node.
    """
    beta, node = float(key[0]), key[1]
    total = int(rows["total"].iloc[0])
    closed = rows[rows["done"]]
    waiting = []
    for _, part in rows[~rows["done"]].sort_values("sa").groupby("item"):
        values = list(zip(part["sa"], (int(n) for n in part["n"])))
        waiting.append((float(part["cap"].iloc[0]), values))
    waiting.sort(key=lambda w: (w[0], [sa for sa, _ in w[1]]))

    out: list[tuple[dict[str, int], float]] = []
    held: dict[str, int] = {}
    share, cap = 0.0, float("inf")

    def put(values: list[tuple[str, int]]) -> None:
        for sa, n in values:
            held[sa] = held.get(sa, 0) + n

    for child_cap, values in waiting:
        size = sum(n for _, n in values)
        cap = min(cap, child_cap)
        share += size / total
        rest, whole = values, True
        flushed = share > cap
        if flushed:
            room = int(np.floor(cap * total)) - sum(held.values())
            room = max(0, min(room, size))
            if room and _cap(room, total, beta) < cap:
                room = 0
            if room:
                taken, rest = _cut(values, room)
                put(taken)
                whole = False
            out.append((dict(held), cap))
            held.clear()
            share, cap = 0.0, float("inf")
        left = sum(n for _, n in rest)
        if not left:
            continue
        put(rest)
        if flushed:
            share = left / total
            if whole or len(rest) > 1:
                cap = min(cap, child_cap)
        cap = min(cap, _cap(left, total, beta))
    out.append((dict(held), cap))

    made = []
    for number, (content, bound) in enumerate(o for o in out if o[0]):
        complete = sum(content.values()) == int(np.floor(bound * total))
        made += [
            (beta, total, f"{node}/{number}", sa, n, bound, complete)
            for sa, n in content.items()
        ]
    columns = [c.split()[0] for c in _ROUND_SCHEMA.split(", ")]
    fresh = pd.DataFrame(made, columns=columns)
    parts = [f for f in (closed[columns], fresh) if len(f)]
    return pd.concat(parts) if parts else fresh


def _cut(
    values: list[tuple[str, int]], room: int
) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """First ``room`` rows of an item in value order, and the remainder."""
    taken, rest = [], []
    for sa, n in values:
        here = min(n, room)
        room -= here
        if here:
            taken.append((sa, here))
        if n > here:
            rest.append((sa, n - here))
    return taken, rest


def overlap_buckets(
    histogram: DataFrame, limits: Sequence[float], paths: DataFrame, height: int
) -> DataFrame:
    """Bottom-up fill along the taxonomy; values may be split over buckets.

    ``height + 1`` rounds. In round r items meet under the r-th ancestor of
    their values; a bucket filled up to its cap leaves, the others go up one
    level, and what is left after the root round is kept. All rounds work on
    the histogram, grouped by (threshold, node).
    """
    items = _with_caps(histogram, limits).select(
        "threshold",
        "total",
        F.col("sa").alias("item"),
        "sa",
        F.col("freq").alias("n"),
        "cap",
        F.lit(False).alias("done"),
    )
    for level in range(1, height + 2):
        up = paths.select(
            F.col("node").alias("sa"),
            F.element_at("path", F.least(F.lit(level + 1), F.size("path"))).alias("__node"),
        )
        items = (
            items.join(up, "sa")
            .groupBy("threshold", "__node")
            .applyInPandas(_fill_group, _ROUND_SCHEMA)
        )
    # An item number is unique below its node; a closed bucket keeps its own.
    buckets = items.groupBy("threshold", "item", "done").agg(
        F.array_sort(F.collect_list(F.struct("sa", "n"))).alias("items"),
        F.sum("n").alias("freq"),
        F.max("cap").alias("cap"),
    )
    return explode_buckets(number_buckets(buckets.drop("item", "done"))).select(*PLAN_COLUMNS)
