"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def likeness_cap(share: Column, beta: Column | float) -> Column:
    """Largest share a value with global share ``share`` may take in a class.

    Enhanced beta-likeness: the relative gain is bounded by ``beta`` and by
    ``-ln(share)``.
    """
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))
    return (F.lit(1.0) + F.least(beta, -F.log(share))) * share


def round_half_up(value: Column, places: int = 2) -> Column:
    """Round to ``places`` digits, halves up, by ``floor(x * 10^p + 0.5)``."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def hundredths(value: Column) -> Column:
    """Share in whole hundredths, as the class rule compares it."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5))


def order_key(value: Column) -> Column:
    """Quantize to 1e-9 so that engines agree on ties despite last digits."""
    return F.floor(value * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def tie_key(pid: Column) -> Column:
    """Order among equal keys: evenly spread, so that ties can be split."""
    return F.md5(pid.cast("string"))


def class_id(level: Column, seq: Column) -> Column:
    """Class number: ``2^level + seq``, unique over all levels."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int")) + seq


def euclidean_norm(columns: list[Column]) -> Column:
    """L2 norm of a list of columns."""
    total = F.lit(0.0)
    for c in columns:
        total = total + c * c
    return F.sqrt(total)
