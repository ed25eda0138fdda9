"""Recoding: make the quasi-identifiers equal within a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import Roles
from ..runtime import small_side
from .stats import categorical_median, ec_means


def _released(roles: Roles, keep_pid: bool) -> list[str]:
    head = [roles.pid] if keep_pid else []
    return [*head, *roles.numeric_qis, *roles.categorical_qis, roles.sa]


#: Classes of the tree levels 0 to 16. A class number is 2^level + sequence, so
#: there are fewer than this many, and any class beyond has at most a
#: 2^17-th of the rows.
TOP_CLASSES = 1 << 17


def _join_classes(assigned: DataFrame, look: DataFrame, classes: int | None) -> DataFrame:
    """Rows joined with one row per class.

    Known to be few, the classes are broadcast. Otherwise only those of the
    top levels are, of which there is a fixed number and which alone can hold
    a large part of the table; the many small ones are joined by a shuffle
    that no single class can skew.
    """
    if classes is not None and classes <= TOP_CLASSES:
        return assigned.join(small_side(look, classes), "ec")
    top = F.col("ec") < TOP_CLASSES
    few = assigned.where(top).join(small_side(look.where(top), TOP_CLASSES), "ec")
    many = assigned.where(~top).join(look.where(~top), "ec")
    return few.unionByName(many)


def recode_mean(
    assigned: DataFrame, roles: Roles, keep_pid: bool = False, classes: int | None = None
) -> DataFrame:
    """Numeric quasi-identifiers become the class mean, the rest stays."""
    means = ec_means(assigned, roles.numeric_qis)
    kept = assigned.drop(*roles.numeric_qis)
    return _join_classes(kept, means, classes).select(*_released(roles, keep_pid))


def recode_minmax(
    assigned: DataFrame, roles: Roles, keep_pid: bool = False, classes: int | None = None
) -> DataFrame:
    """As :func:`recode_mean`; categorical ones become ``min-max`` of the class."""
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in roles.numeric_qis]
    aggs += [
        F.concat_ws("-", F.min(c), F.max(c)).alias(c) for c in roles.categorical_qis
    ]
    look = assigned.groupBy("ec").agg(*aggs)
    kept = assigned.drop(*roles.numeric_qis, *roles.categorical_qis)
    return _join_classes(kept, look, classes).select(*_released(roles, keep_pid))


def recode_median(
    assigned: DataFrame, roles: Roles, keep_pid: bool = False, classes: int | None = None
) -> DataFrame:
    """As :func:`recode_mean`; categorical ones become the class median."""
    if not roles.categorical_qis:
        return recode_mean(assigned, roles, keep_pid, classes)
    look = ec_means(assigned, roles.numeric_qis).join(
        categorical_median(assigned, roles.categorical_qis), "ec"
    )
    kept = assigned.drop(*roles.numeric_qis, *roles.categorical_qis)
    return _join_classes(kept, look, classes).select(*_released(roles, keep_pid))
