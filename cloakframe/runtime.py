"""Where intermediate tables live.

Tables that are read more than once (bucket plans, class plans, Mondrian
levels) are written to the folder the session names in
``spark.checkpoint.dir`` and read back. A written table survives the loss of
an executor, cuts the lineage, and gives the optimizer its true size, so that
the choice between a broadcast and a shuffled join rests on bytes on disk.

A table that nothing reads any more is removed with :func:`discard`; results
are lazy and may read the others, so the caller removes these with
:func:`discard_all` when its results are written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side (in estimated bytes) that is ever given a broadcast hint.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Intermediate tables that are still there, per application.
_written: dict[str, set[str]] = {}
#: Catalog names of those that are bucketed tables, by path.
_named: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, from ``spark.checkpoint.dir``.

    Where that is not set, a session on one machine keeps them beside its
    tables, below ``spark.sql.warehouse.dir``.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    in_use = context.getCheckpointDir()
    if in_use:
        return in_use.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/cloakframe/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, label: str, buckets: int, key: str) -> DataFrame:
    """Write ``df`` once as a table of the catalog, bucketed by ``key``: joins and
    aggregates on the key read it as it lies. Removed like other intermediate tables."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = f"{re.sub('[^a-z0-9]', '_', label.lower())}_{path.rsplit('-', 1)[1]}"
    _named[path] = name
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from :func:`materialize`; nothing may read them any more."""
    for df in tables:
        names = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
        spark = df.sparkSession
        for path in list(_written.get(spark.sparkContext.applicationId, ())):
            if path.rsplit("/", 1)[-1] in names:
                _remove(spark, path)


def written(spark: SparkSession) -> set[str]:
    """Paths of the intermediate tables that are there now."""
    return set(_written.get(spark.sparkContext.applicationId, ()))


def discard_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove those of the intermediate tables at ``paths`` that are still there."""
    for path in written(spark) & set(paths):
        _remove(spark, path)


def discard_all(spark: SparkSession) -> int:
    """Remove every intermediate table of this application; returns their number."""
    paths = list(_written.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _remove(spark, path)
    return len(paths)


def small_side(df: DataFrame, rows: int, row_bytes: int = 128) -> DataFrame:
    """Mark ``df`` for broadcast if its known row count is small enough.

    Above the bound the frame is returned as it is, and the join is planned
    as a shuffled join (with adaptive skew handling).
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
