"""Pipelines: from microdata to a release, and the threshold sweep."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bucketing import (
    PLAN_COLUMNS,
    beta_buckets,
    overlap_buckets,
    tclose_buckets,
)
from ..operators.classes import bucket_sizes, class_states, count_classes, seat_runs
from ..operators.mondrian import mondrian_partition
from ..operators.ranking import CELL_ROWS
from ..operators.recode import recode_mean
from ..operators.redistribute import redistribute_by_norm
from ..operators.stats import Scaling, fit_scaling, sa_histogram
from ..roles import Roles, check_unique, project_roles
from ..runtime import materialize

@dataclass(frozen=True)
class Method:
    """A way to bucket the sensitive values and to split classes.

    ``buckets(histogram, thresholds, paths, height)`` gives a bucket plan: the
    columns ``bucketing.PLAN_COLUMNS``, for each threshold and value quotas that
    add up to the value's count. ``rule`` is a split rule of
    ``classes.class_states``: a name, or a function of its own. ``taxonomy`` tells
    whether the method needs the taxonomy of the sensitive attribute.
    """

    buckets: Callable[[DataFrame, Sequence[float], DataFrame | None, int | None], DataFrame]
    rule: str | Callable = "likeness"
    taxonomy: bool = False


#: The methods by name; callers may add theirs.
METHODS = {
    "beta": Method(lambda histogram, limits, paths, height: beta_buckets(histogram, limits)),
    "overlap": Method(overlap_buckets, taxonomy=True),
    "tclose": Method(tclose_buckets, "emd", taxonomy=True),
}
_OWN = tuple(METHODS)


def find_method(method: str | Method) -> Method:
    if isinstance(method, Method):
        return method
    if method not in METHODS:
        raise ValueError(f"method must be one of {tuple(METHODS)}")
    return METHODS[method]


def _checked(plan: DataFrame, histogram: DataFrame, limits: Sequence[float]) -> DataFrame:
    """The written plan of a caller's method, if it deals out every row once."""
    if missing := set(PLAN_COLUMNS) - set(plan.columns):
        raise ValueError(f"the bucket plan lacks {sorted(missing)}")
    plan = materialize(plan.select(*PLAN_COLUMNS), "caller-plan")
    dealt = plan.groupBy("threshold", "sa").agg(F.sum("quota").alias("quota"))
    listed = F.explode(F.array(*[F.lit(float(v)) for v in limits]))
    every = histogram.select("sa", "freq", listed.alias("threshold"))
    wrong = dealt.join(every, ["threshold", "sa"], "full").where("NOT (quota <=> freq)")
    sizes = plan.groupBy("threshold", "bucket").agg(
        F.sum("quota").alias("quota"), F.max("freq").alias("most"), F.min("freq").alias("least")
    )
    if not wrong.isEmpty() or not sizes.where("quota <> most OR quota <> least").isEmpty():
        raise ValueError("the quotas of the bucket plan do not add up to the values' and buckets' rows")
    return plan


def bucket_plan(
    df: DataFrame,
    sa: str,
    method: str | Method,
    limits: Sequence[float],
    paths: DataFrame | None = None,
    height: int | None = None,
) -> DataFrame:
    """Bucket plan of every threshold, from one histogram."""
    made = find_method(method)
    if made.taxonomy and (paths is None or height is None):
        raise ValueError(f"{method} needs the taxonomy of the sensitive attribute")
    histogram = sa_histogram(df, sa)
    plan = made.buckets(histogram, limits, paths, height)
    return plan if any(made is METHODS.get(name) for name in _OWN) else _checked(plan, histogram, limits)


@dataclass(frozen=True)
class ClassPlan:
    """Written bucket plan and class states of one run, and their seat runs.

    ``levels`` is the number of tree levels that hold classes.
    """

    plan: DataFrame
    states: DataFrame
    runs: DataFrame
    classes: int
    levels: int


def class_plan(
    df: DataFrame,
    sa: str,
    method: str | Method,
    threshold: float,
    paths: DataFrame | None = None,
    height: int | None = None,
    min_class_size: int = 1,
) -> ClassPlan:
    """Buckets and classes for one threshold.

    Plan and states are as small as the histogram; they are written once,
    because the row path reads them several times.
    """
    plan = materialize(bucket_plan(df, sa, method, [threshold], paths, height), "buckets")
    states = materialize(class_states(plan, find_method(method).rule, min_class_size), "states")
    leaf = ~F.col("splits")
    classes, levels = states.agg(
        F.sum(F.when(leaf, F.col("nodes"))), F.countDistinct(F.when(leaf, F.col("level")))
    ).first()
    if not classes:
        raise ValueError("no buckets: the table is empty")
    if classes == 1:
        warnings.warn("the threshold admits a single class: the whole table", stacklevel=3)
    return ClassPlan(plan, states, seat_runs(plan, states), classes, levels)


def assign_classes(
    df: DataFrame,
    roles: Roles,
    made: ClassPlan,
    scaling: Scaling | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The role columns of ``df`` with ``bucket`` and ``ec``.

    The table is written: recoding and audits read it more than once, and the
    rows are ranked and shuffled once.
    """
    rows = project_roles(df, roles)
    assigned = redistribute_by_norm(
        rows, roles, made.plan, made.runs, made.levels, scaling, cell_rows
    )
    return materialize(assigned, "assigned")


def anonymize(
    df: DataFrame,
    roles: Roles,
    method: str | Method,
    threshold: float,
    paths: DataFrame | None = None,
    height: int | None = None,
    keep_pid: bool = False,
    min_class_size: int = 1,
    check: bool = True,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Release table of ``beta``, ``overlap`` or ``tclose`` anonymization, or of a
    :class:`Method` of the caller."""
    df = project_roles(df, roles)
    scaling = fit_scaling(df, roles.numeric_qis, required=roles.columns if check else ())
    if check:
        check_unique(df, roles)
    made = class_plan(df, roles.sa, method, threshold, paths, height, min_class_size)
    assigned = assign_classes(df, roles, made, scaling, cell_rows)
    return recode_mean(assigned, roles, keep_pid, made.classes)


def anonymize_mondrian(
    df: DataFrame, roles: Roles, k: int, keep_pid: bool = False, check: bool = True, **options
) -> DataFrame:
    """Release table of Mondrian k-anonymity."""
    if check:
        check_unique(df, roles)
    made = mondrian_partition(df, roles, k, recode=True, **options)
    head = [roles.pid] if keep_pid else []
    return made.select("ec", *head, *roles.numeric_qis, roles.sa)


def threshold_sweep(
    df: DataFrame,
    sa: str,
    method: str | Method,
    start: float,
    stop: float,
    step: float,
    paths: DataFrame | None = None,
    height: int | None = None,
) -> DataFrame:
    """Buckets and classes for the thresholds ``start + i * step`` up to ``stop``.

    The start itself is not tried (i begins at 1). All thresholds share one
    histogram and one job per phase; the two timings are those of the phases.
    """
    if step <= 0 or stop <= start:
        raise ValueError("the sweep needs step > 0 and stop > start")
    count = math.ceil((stop - start) / step - 1e-9)
    limits = [start + i * step for i in range(1, count + 1)]
    began = time.monotonic()
    plan = materialize(bucket_plan(df, sa, method, limits, paths, height), "buckets")
    planned = time.monotonic()
    states = materialize(class_states(plan, find_method(method).rule), "states")
    ended = time.monotonic()
    buckets = bucket_sizes(plan).groupBy("threshold").agg(F.count(F.lit(1)).alias("buckets"))
    return buckets.join(count_classes(states), "threshold").select(
        "threshold",
        "buckets",
        "classes",
        F.lit(planned - began).alias("bucket_seconds"),
        F.lit(ended - planned).alias("class_seconds"),
    )
