"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.runtime import materialize, materialize_bucketed

__all__ = ["byte_slices", "distinct_texts", "lean", "materialize", "pieces", "slices", "text_key", "whole", "workers"]


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column) -> Column:
    """128-bit key of a text's bytes; equal texts share it."""
    return F.unhex(F.md5(whole(text).cast("binary")))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, text, copies) per distinct text, written once, bucketed by key.

    Joins on the key read the table as it lies; the texts are not shuffled again.
    """
    rows = docs.select(text_key(text_col).alias("key"), whole(text_col).alias("text"))
    made = rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return materialize_bucketed(made, "texts", workers(docs), "key")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at least one row whose texts in ``column`` have at most
    ``most`` bytes, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def lean(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``apply`` for a task whose worker goes on to others: when its batches are done, the
    worker gives back the memory that it does not use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def pieces(rows: Iterable[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Row dictionaries as Arrow batches of bounded size."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def workers(df: DataFrame) -> int:
    """Partitions for a shuffle of a whole table: as the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
