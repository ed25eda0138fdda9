"""Best-fit packing of whole documents into sequences of one token capacity.

A document is its ids and an end id. Only longer documents are cut, into full
pieces, with a shorter first piece for what is over. The pieces are counted by
length; the counts (one per length, whatever the number of pieces) are packed by
bin completion branch-and-bound (``binpack``), and every piece finds its place by
its rank among the pieces of its length: patterns are given out in *runs* of
ranks. A length that very many pieces share is ranked in buckets, so no task holds
all of them. Ids stay in the task that made them; only lengths are shuffled.

Defined results: a null or empty text is the end id alone; repeated rows and null
identifiers are packed like any other row; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.binpack import Packing, pack
from cloakframe.llm.common import lean, materialize, workers
from cloakframe.llm.tokens import BLOCK_BYTES, encode

END_ID = 2
#: Plan rows that a broadcast may hold; lengths and patterns are bounded by the capacity.
RUN_LIMIT = 1 << 20

_PIECE = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def text_blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most BLOCK_BYTES of text (or one row)."""
    size = np.cumsum(
        pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    )
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + BLOCK_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def pieces(docs: DataFrame, text_col: str, keep: list[str], capacity: int, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length, ids_crc32 (and ids)."""
    kept = docs.select(F.col(text_col).alias("_text"), *keep)
    extra = [("ids", pa.list_(pa.int32()))] if with_ids else []

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch, 0):
                rows: list[int] = []
                cols: list[list] = [[] for _ in [*_PIECE, *extra]]
                for i, body in enumerate(encode(part.column(0))):
                    ids = np.append(body, np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                        some = ids[start : start + length]
                        rows.append(i)
                        values = (k, start, length, zlib.crc32(some.tobytes()), some.astype(np.int32))
                        for col, value in zip(cols, values):
                            col.append(value)
                taken = part.select(keep).take(pa.array(rows, pa.int64())) if keep else None
                made = [pa.array(c, t) for c, (_, t) in zip(cols, [*_PIECE, *extra])]
                yield pa.RecordBatch.from_arrays(
                    [*(taken.columns if keep else []), *made], [*keep, *(n for n, _ in [*_PIECE, *extra])]
                )

    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()}
    fields = [*kept.schema[1:], *(T.StructField(n, t) for n, t in kinds.items())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return kept.mapInArrow(lean(apply), T.StructType(fields))


def runs(packing: Packing) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each slot of each pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in packing.patterns:
        offset = 0
        for size in pattern:
            rank = used.get(size, 0)
            out.append((size, rank, rank + times, sequence, offset))
            used[size] = rank + times
            offset += size
        sequence += times
    return out


def pack_pieces(table: DataFrame, capacity: int, max_nodes: int = 3000) -> DataFrame:
    """``table(_row, length, ...)`` with sequence_id and offset.

    ``table`` is written already (it is read for the counts and for the ranks), and
    ``_row`` tells its rows apart. Columns that start with an underscore are used
    inside.
    """
    names = [c for c in table.columns if c != "_row"]
    buckets = workers(table)
    spread = table.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "length-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    packing = pack(by_length, capacity, max_nodes)
    plan = runs(packing)
    if len(plan) > RUN_LIMIT:
        raise RuntimeError("the packing plan exceeds its bound")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = spread.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    schema = "_length long, _from long, _to long, _sequence long, _offset long"
    places = table.sparkSession.createDataFrame(plan, schema)
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(places), here).select(
        *[F.col(c) for c in names],
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    keep: list[str],
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and place (see the module)."""
    made = pieces(docs, text_col, keep, capacity, end_id, with_ids)
    return pack_pieces(materialize(made.withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)
