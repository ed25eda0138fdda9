"""Column roles of a microdata table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Which columns identify, quasi-identify and hold the sensitive value."""

    pid: str
    numeric_qis: tuple[str, ...]
    categorical_qis: tuple[str, ...]
    sa: str

    def __init__(
        self,
        pid: str,
        numeric_qis: Sequence[str],
        sa: str,
        categorical_qis: Sequence[str] = (),
    ):
        object.__setattr__(self, "pid", pid)
        object.__setattr__(self, "numeric_qis", tuple(numeric_qis))
        object.__setattr__(self, "categorical_qis", tuple(categorical_qis))
        object.__setattr__(self, "sa", sa)
        names = self.columns
        if len(set(names)) != len(names):
            raise ValueError(f"a column has two roles: {names}")
        if not self.numeric_qis:
            raise ValueError("at least one numeric quasi-identifier is needed")

    @property
    def columns(self) -> list[str]:
        return [self.pid, *self.numeric_qis, *self.categorical_qis, self.sa]

    @staticmethod
    def from_descriptor(descriptor: DataFrame, names: Sequence[str], pid: int, sa: int) -> Roles:
        """Roles from a column descriptor (one row per column of the file)."""
        kinds = {r["index"]: r["is_numeric"] for r in descriptor.limit(len(names) + 1).collect()}
        if sorted(kinds) != list(range(len(names))):
            raise ValueError("the descriptor must list every column once")
        qis = [i for i in range(len(names)) if i not in (pid, sa)]
        return Roles(
            pid=names[pid],
            numeric_qis=[names[i] for i in qis if kinds[i]],
            categorical_qis=[names[i] for i in qis if not kinds[i]],
            sa=names[sa],
        )


def as_number(df: DataFrame, column: str) -> Column:
    """A numeric quasi-identifier as a double; dates count days from 1970-01-01."""
    if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(F.col(column).cast("date")).cast("double").alias(column)
    return F.col(column).cast("double").alias(column)


def project_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Keep the columns with a role: numeric ones as double, the SA as text."""
    return df.select(
        F.col(roles.pid),
        *[as_number(df, c) for c in roles.numeric_qis],
        *[F.col(c).cast("string").alias(c) for c in roles.categorical_qis],
        F.col(roles.sa).cast("string").alias(roles.sa),
    )


def drop_sensitive(df: DataFrame, roles: Roles) -> DataFrame:
    """Remove the sensitive column and cast the quasi-identifiers to double."""
    return df.select(
        F.col(roles.pid),
        *[as_number(df, c) for c in roles.numeric_qis],
    )


def check_unique(df: DataFrame, roles: Roles) -> None:
    """Fail early on repeated identifiers.

    Reads the identifier column alone; counts are combined before the shuffle.
    """
    repeated = (
        df.groupBy(roles.pid).count().where(F.col("count") > 1).limit(1).collect()
    )
    if repeated:
        raise ValueError(f"identifier {roles.pid} is not unique, e.g. {repeated[0][0]!r}")
