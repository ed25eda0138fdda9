"""Equivalence classes: from bucket sizes to class sizes.

A class is a node of a binary tree. Its left child takes half of every bucket
rounded down, its right child the rest. With ``path`` = sum of the branch bits
(1 = right) times 2^(depth of the branch), the node ``(level, path)`` holds
exactly ``(freq + path) div 2^level`` rows of a bucket of ``freq`` rows.

At one level a bucket therefore has at most two sizes, and all nodes whose
paths lie between two neighbouring switch points have the same sizes: a
*state*. There are at most (buckets + 1) states per level however many classes
there are, and the children of a state are states. So the split rule is
evaluated per state, the number of classes is counted per state, and neither
needs the classes one by one. :func:`expand_nodes` lists them when asked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, small_side

#: threshold, level and first path of the state; does a node of it split; the
#: states of its children; its nodes; for a leaf state the number of leaves of
#: the level that come before it in path order.
STATE_SCHEMA = (
    "threshold double, level int, state bigint, splits boolean, "
    "left_state bigint, right_state bigint, nodes bigint, first_seq bigint"
)

#: From the sizes of a node to whether it may be a class.
Rule = Callable[[np.ndarray], bool]
#: (path of a state, level of its nodes) -> whether they may be classes.
Fits = Callable[[int, int], bool]


def _least_totals(sizes: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Smallest total at which a size's share, in whole hundredths, is within its bound."""

    def over(total: np.ndarray) -> np.ndarray:
        return np.floor(sizes / np.maximum(total, 1).astype(np.float64) * 100.0 + 0.5) > bound

    # The share falls as the total grows; an estimate is off by its rounding only.
    total = np.maximum(np.floor(sizes * 100.0 / (bound + 0.5)), sizes).astype(np.int64)
    while (low := over(total)).any():
        total[low] += 1
    while (high := (total > np.maximum(sizes, 1)) & ~over(total - 1)).any():
        total[high] -= 1
    return total


def likeness_fits(freq: np.ndarray, cap: np.ndarray, threshold: float) -> Fits:
    """Every bucket's share, in whole hundredths, stays within its cap.

    At a level a bucket has two sizes, the larger one from its switch point on, and
    with each it demands a least total. In the order of the switch points the states
    of a level are prefixes, so prefix and suffix maxima of the demands and the
    number of switched buckets tell all of them; equal buckets are taken once.
    """
    kinds, times = np.unique(np.stack([freq.astype(np.float64), np.floor(cap * 100.0 + 0.5)]), axis=1, return_counts=True)
    freq, bound = kinds[0].astype(np.int64), kinds[1]
    tables: dict[int, tuple] = {}

    def table(level: int) -> tuple:
        if level not in tables:
            tables.clear()  # levels are asked one after the other
            width = 1 << level
            low = freq >> level
            switch = width - (freq & (width - 1))
            order = np.argsort(switch, kind="stable")
            before, after = _least_totals(low, bound)[order], _least_totals(low + 1, bound)[order]
            done = np.concatenate([[0], np.maximum.accumulate(after)])
            todo = np.concatenate([np.maximum.accumulate(before[::-1])[::-1], [0]])
            switched = np.concatenate([[0], np.cumsum(times[order])])
            tables[level] = switch[order], np.maximum(done, todo), int((low * times).sum()), switched
        return tables[level]

    def fits(path: int, level: int) -> bool:
        switch, needed, base, switched = table(level)
        at = int(np.searchsorted(switch, path, side="right"))
        total = base + int(switched[at])
        return total > 0 and total >= int(needed[at])

    return fits


def fits_by_sizes(rule: Callable[[np.ndarray, np.ndarray, float], Rule]):
    """A rule on the sizes of one node, asked for each state."""

    def make(freq: np.ndarray, cap: np.ndarray, threshold: float) -> Fits:
        holds = rule(freq, cap, threshold)

        def fits(path: int, level: int) -> bool:
            sizes = (freq + path) >> level
            return bool(sizes.any()) and holds(sizes)

        return fits

    return make


def emd_rule(freq: np.ndarray, cap: np.ndarray, threshold: float) -> Rule:
    """Sum of caps + distance of the shares to the overall shares <= threshold."""
    overall = freq / float(freq.sum())
    base = float(cap.sum())

    def holds(sizes: np.ndarray) -> bool:
        total = float(sizes.sum())
        if total <= 0:
            return False
        distance = np.abs(np.cumsum(sizes / total - overall)).sum()
        return base + float(distance) <= threshold

    return holds


RULES = {"likeness": likeness_fits, "emd": fits_by_sizes(emd_rule)}


def _first_path(switches: np.ndarray, path: int) -> int:
    """State of a path: the last switch point at or below it."""
    at = int(np.searchsorted(switches, path, side="right"))
    return int(switches[at - 1]) if at else 0


def _states_of(rule: str | Callable[[np.ndarray, np.ndarray, float], Rule], min_size: int):
    make = fits_by_sizes(rule) if callable(rule) else RULES[rule]

    def walk(key: tuple, buckets: pd.DataFrame) -> pd.DataFrame:
        buckets = buckets.sort_values("bucket")
        freq = buckets["freq"].to_numpy(np.int64)
        holds = make(freq, buckets["cap"].to_numpy(np.float64), float(key[0]))
        if min_size > 1:
            large = fits_by_sizes(lambda *_: lambda sizes: int(sizes.sum()) >= min_size)(freq, freq, 0.0)
        else:
            large = lambda *_: True
        out = []
        current = {0: 1}
        level = 0
        while current:
            width = 1 << (level + 1)
            switches = np.unique(width - freq % width)
            switches = switches[switches < width]
            verdict: dict[int, bool] = {}

            def fits(state: int) -> bool:
                if state not in verdict:
                    verdict[state] = large(state, level + 1) and holds(state, level + 1)
                return verdict[state]

            below: dict[int, int] = {}
            leaves = 0
            for state in sorted(current):
                nodes = current[state]
                left = _first_path(switches, state)
                right = _first_path(switches, state + (width >> 1))
                splits = fits(left) and fits(right)
                out.append(
                    (key[0], level, state, splits, left, right, nodes, None if splits else leaves)
                )
                if splits:
                    below[left] = below.get(left, 0) + nodes
                    below[right] = below.get(right, 0) + nodes
                else:
                    leaves += nodes
            current = below
            level += 1
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATE_SCHEMA.split(", ")])
        return frame.astype({"first_seq": "Int64"})

    return walk


def bucket_sizes(plan: DataFrame) -> DataFrame:
    """One row per bucket of a plan in long form."""
    return plan.select("threshold", "bucket", "freq", "cap").distinct()


def class_states(plan: DataFrame, rule: str | Callable, min_size: int = 1) -> DataFrame:
    """States of the class tree of every threshold.

    ``plan`` is a bucket plan; ``rule`` is ``likeness``, ``emd``, or a function of
    (bucket sizes of the table, caps, threshold) that gives a function from the
    bucket sizes of a node, in the order of the buckets, to whether the node may be
    a class (it is given nodes with rows only). ``min_size`` optionally forbids
    classes of fewer rows. Thresholds are processed in parallel; a task holds the
    bucket list of one threshold.
    """
    sizes = bucket_sizes(plan).where(F.col("freq") > 0)
    return sizes.groupBy("threshold").applyInPandas(_states_of(rule, min_size), STATE_SCHEMA)


def count_classes(states: DataFrame) -> DataFrame:
    """``(threshold, classes)`` without listing a class."""
    return (
        states.where(~F.col("splits"))
        .groupBy("threshold")
        .agg(F.sum("nodes").cast("bigint").alias("classes"))
    )


#: Levels after which the frontier is written out and spread again.
EXPAND_LEVELS = 10


def expand_nodes(states: DataFrame, leaves_only: bool = True) -> DataFrame:
    """List the nodes of the tree: ``threshold, level, path, state[, splits]``.

    A node is followed downwards by a look-up of its state, so a level is a
    map over the frontier without a shuffle. Every ``EXPAND_LEVELS`` levels
    the frontier, grown up to 2^10 times, is written and redistributed.
    """
    states = states.select("threshold", "level", "state", "splits", "left_state", "right_state")
    size = states.agg(F.max("level"), F.count(F.lit(1)), F.count_if("splits")).first()
    deepest, rows = size[0] or 0, size[1]
    rules = small_side(
        states.where("splits").select(
            F.col("threshold").alias("__threshold"),
            F.col("level").alias("__level"),
            F.col("state").alias("__state"),
            "left_state",
            "right_state",
        ),
        rows,
    )
    nodes = states.where(F.col("level") == 0).select(
        "threshold", "level", F.lit(0).cast("bigint").alias("path"), "state"
    )
    for level in range(deepest):
        step = F.lit(1 << level).cast("bigint")

        def child(path, state):
            return F.struct(
                F.lit(level + 1).alias("level"), path.alias("path"), state.alias("state")
            )

        itself = F.struct("level", "path", "state")
        split = F.col("left_state").isNotNull()
        both = F.array(
            child(F.col("path"), F.col("left_state")),
            child(F.col("path") + step, F.col("right_state")),
        )
        shown = both if leaves_only else F.concat(F.array(itself), both)
        nodes = nodes.join(
            rules,
            (F.col("threshold") == F.col("__threshold"))
            & (F.col("level") == F.col("__level"))
            & (F.col("state") == F.col("__state"))
            & (F.col("level") == level),
            "left",
        ).select(
            "threshold",
            F.inline(F.when(split, shown).otherwise(F.array(itself))),
        )
        if (level + 1) % EXPAND_LEVELS == 0 and level + 1 < deepest:
            spread = 4 * nodes.sparkSession.sparkContext.defaultParallelism
            nodes = materialize(nodes.repartition(spread, "threshold", "path"), "frontier")
    if leaves_only:
        return nodes
    flags = small_side(states.select("threshold", "level", "state", "splits"), rows)
    return nodes.join(flags, ["threshold", "level", "state"])


def split_tree(plan: DataFrame, rule: str | Callable, min_size: int = 1) -> DataFrame:
    """All nodes the halving visits, with the verdict: splits or leaf."""
    states = materialize(class_states(plan, rule, min_size), "states")
    return expand_nodes(states, leaves_only=False).select("threshold", "level", "path", "splits")


def collect_leaves(plan: DataFrame, states: DataFrame) -> DataFrame:
    """Classes in long form: ``threshold, level, path, bucket, size``."""
    leaves = expand_nodes(states).select("threshold", "level", "path")
    size = F.expr("shiftright(freq + path, level)")
    return leaves.join(small_side(bucket_sizes(plan), plan.count()), "threshold").select(
        "threshold", "level", "path", "bucket", size.alias("size")
    )


def seat_runs(plan: DataFrame, states: DataFrame) -> DataFrame:
    """Per bucket, runs of classes that take the same number of its rows.

    ``threshold, bucket, size, level, classes, first_seq, row_lo``: the
    ``classes`` classes of this level numbered from ``first_seq`` take
    ``size`` rows each, starting at row ``row_lo`` of the bucket. Runs are
    ordered by size (largest first), then level. At one level a bucket has two
    sizes; the classes before its switch point take the smaller one. They are
    counted by merging the switch points into the ordered leaf states.
    """
    leaves = states.where(~F.col("splits")).select("threshold", "level", "state", "nodes")
    per_level = leaves.groupBy("threshold", "level").agg(F.sum("nodes").alias("all"))
    cells = (
        per_level.join(bucket_sizes(plan).where(F.col("freq") > 0), "threshold")
        .withColumn("low", F.expr("shiftright(freq, level)"))
        .withColumn("switch", F.expr("shiftleft(1L, level) - (freq - shiftleft(low, level))"))
    )
    marks = cells.select(
        "threshold", "level", F.col("switch").alias("at"), F.lit(0).alias("kind"),
        F.lit(0).cast("bigint").alias("nodes"), "bucket", "low", "all",
    )
    steps = leaves.select(
        "threshold", "level", F.col("state").alias("at"), F.lit(1).alias("kind"), "nodes",
        F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("bigint").alias("low"),
        F.lit(None).cast("bigint").alias("all"),
    )
    w = Window.partitionBy("threshold", "level").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = (
        marks.unionByName(steps)
        .withColumn("before", F.sum("nodes").over(w))
        .where(F.col("kind") == 0)
    )
    runs = counted.select(
        "threshold",
        "bucket",
        "level",
        F.inline(
            F.array(
                F.struct(
                    F.col("low").alias("size"),
                    F.col("before").alias("classes"),
                    F.lit(0).cast("bigint").alias("first_seq"),
                ),
                F.struct(
                    (F.col("low") + 1).alias("size"),
                    (F.col("all") - F.col("before")).alias("classes"),
                    F.col("before").alias("first_seq"),
                ),
            )
        ),
    ).where((F.col("classes") > 0) & (F.col("size") > 0))
    order = Window.partitionBy("threshold", "bucket").orderBy(F.desc("size"), "level").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return runs.withColumn(
        "row_lo",
        F.coalesce(F.sum(F.col("size") * F.col("classes")).over(order), F.lit(0)).cast("bigint"),
    )


#: Classes of a run that one row lists.
CHUNK_CLASSES = 1 << 16


def _listed(runs: DataFrame) -> DataFrame:
    """One row per class of every run, numbered ``k`` from 0.

    A run may have very many classes: it is cut into chunks of fixed length,
    and the chunks are spread before each lists its classes.
    """
    zero, chunk = F.lit(0).cast("bigint"), F.lit(CHUNK_CLASSES).cast("bigint")
    last = F.floor((F.col("classes") - 1) / chunk).cast("bigint")
    parts = runs.withColumn("__chunk", F.explode(F.sequence(zero, last)))
    spread = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(spread, "threshold", "bucket", "level", "size", "__chunk")
    first = F.col("__chunk") * chunk
    return parts.withColumn(
        "k", F.explode(F.sequence(first, F.least("classes", first + chunk) - 1))
    ).drop("__chunk")


def expand_seats(runs: DataFrame) -> DataFrame:
    """One row per seat of every bucket, numbered from 1 (for inspection).

    The engine never builds this table; see :func:`seat_runs`.
    """
    return _listed(runs).select(
        "threshold",
        "bucket",
        "level",
        (F.col("first_seq") + F.col("k")).alias("seq"),
        "size",
        F.explode(
            F.sequence(
                F.col("row_lo") + F.col("k") * F.col("size") + 1,
                F.col("row_lo") + (F.col("k") + 1) * F.col("size"),
            )
        ).alias("seat"),
    )


def rank_seats(runs: DataFrame) -> DataFrame:
    """Per bucket and class: size and first seat, in seat order."""
    return _listed(runs).select(
        "threshold",
        "bucket",
        "level",
        (F.col("first_seq") + F.col("k")).alias("seq"),
        "size",
        (F.col("row_lo") + F.col("k") * F.col("size") + 1).alias("first_seat"),
    )
