"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Roles, project_roles

#: Where a csv reader puts a line that it cannot take apart.
_RECORD = "_record"


def load_microdata(
    spark: SparkSession,
    path: str,
    roles: Roles,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    sep: str = ",",
    mode: str = "FAILFAST",
) -> DataFrame:
    """Role columns of a table of personal records.

    For text, ``columns`` names the fields in file order; numeric roles are
    read as double. ``mode`` is Spark's parse mode: ``FAILFAST`` stops at a bad
    number, ``DROPMALFORMED`` leaves its row out.
    """
    if fmt == "csv":
        if columns is None:
            raise ValueError("a csv file needs the column names in file order")
        schema = T.StructType(
            [
                T.StructField(
                    c, T.DoubleType() if c in roles.numeric_qis else T.StringType(), True
                )
                for c in columns
            ]
        )
        raw = spark.read.csv(path, schema=schema, sep=sep, mode=mode)
    else:
        raw = spark.read.format(fmt).load(path)
    return project_roles(raw, roles)


class Load(NamedTuple):
    """Rows that can be anonymized, and those that cannot with the reason."""

    rows: DataFrame
    rejects: DataFrame

    def write_rejects(self, path: str, mode: str = "errorifexists") -> DataFrame:
        """Write the rejected rows as they were read; a reader of the written rows."""
        self.rejects.write.mode(mode).parquet(path)
        return self.rejects.sparkSession.read.parquet(path)


def load_with_rejects(
    spark: SparkSession,
    path: str,
    roles: Roles,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    sep: str = ",",
) -> Load:
    """:func:`load_microdata` that sets bad rows aside instead of stopping.

    ``rejects`` has the fields as text, the whole ``record`` of a line with too
    few or too many fields, and a ``reason``: ``wrong number of fields``, or the
    first role column, in the order of the roles, that is ``missing``, ``not a
    number`` or ``not finite``. Every row of the source is in one of the two. Empty
    text fields are missing; an empty source gives two empty tables.
    """
    used = list(roles.columns)
    record = F.lit(None).cast("string")
    if fmt == "csv":
        if columns is None:
            raise ValueError("a csv file needs the column names in file order")
        fields = ", ".join(f"`{c}` string" for c in [*columns, _RECORD])
        # Without pruning: the fields of a line are counted whatever is asked for.
        reader = spark.read.option("columnPruning", "false")
        raw = reader.csv(path, schema=fields, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD)
        record = F.col(_RECORD)
    else:
        raw = spark.read.format(fmt).load(path)
    text = {c: F.col(c).cast("string") for c in raw.columns if c != _RECORD}
    days = {f.name for f in raw.schema if isinstance(f.dataType, (T.DateType, T.TimestampType))}

    reason = F.when(record.isNotNull(), F.lit("wrong number of fields"))
    for c in used:
        reason = reason.when(F.col(c).isNull(), F.lit(f"{c}: missing"))
        if c in roles.numeric_qis and c not in days:
            number = F.col(c).try_cast("double")
            reason = reason.when(number.isNull(), F.lit(f"{c}: not a number"))
            unbounded = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
            reason = reason.when(unbounded, F.lit(f"{c}: not finite"))
    told = raw.withColumn("__reason", reason)
    good = told.where("__reason IS NULL").drop("__reason", _RECORD)
    numbers = {c: F.col(c).try_cast("double") for c in roles.numeric_qis if c not in days}
    rejects = told.where("__reason IS NOT NULL").select(
        *[t.alias(c) for c, t in text.items() if c not in ("record", "reason")],
        record.alias("record"),
        F.col("__reason").alias("reason"),
    )
    return Load(project_roles(good.withColumns(numbers), roles), rejects)


def load_descriptor(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(index, is_numeric, height)`` of every column of a text file."""
    raw = spark.read.csv(
        path, schema="index int, is_numeric int, height int", sep=sep, mode="FAILFAST"
    )
    return raw.select("index", (F.col("is_numeric") == 1).alias("is_numeric"), "height")


def load_taxonomy(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Edges ``(child, parent)`` of a taxonomy file."""
    return spark.read.csv(path, schema="child string, parent string", sep=sep, mode="FAILFAST")


def with_row_id(
    df: DataFrame, columns: Sequence[str] | None = None, name: str = "row_id"
) -> DataFrame:
    """64-bit fingerprint of a row's values: of all columns, or of those given.

    Equal rows share it; the identifier column stays the key of a row.
    """
    return df.withColumn(name, F.xxhash64(*[F.col(c) for c in columns or df.columns]))


def write_release(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"):
    """Write a release as typed columns (or as text for ``csv``)."""
    df.write.mode(mode).format(fmt).save(path)


def write_assigned(assigned: DataFrame, path: str, mode: str = "errorifexists"):
    """Keep the table of rows and classes for later audits."""
    assigned.write.mode(mode).parquet(path)


def write_assigned_table(assigned: DataFrame, name: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Keep the table of rows and classes as a table of the catalog, bucketed and
    sorted by ``ec``: audits per class read it without a shuffle."""
    assigned.write.mode(mode).bucketBy(buckets, "ec").sortBy("ec").format("parquet").saveAsTable(name)
    return assigned.sparkSession.table(name)


def drop_assigned_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_assigned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
