"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

A text is cut into words and punctuation runs (case kept). Single pieces, pairs
of neighbours, and the fact that a piece repeats the one before it are hashed
into ``2**BITS`` features. A feature's value is the square root of its count,
scaled to unit length over the text. The weights are learnt by the
follow-the-regularised-leader rule with per-feature rates; a score is one sparse
dot product.

Training reads a bounded sample of labelled rows (``max_rows``, chosen by a hash
of the identifier). It runs in passes: each shard of the sample follows the rule
from the shared state, and the states are averaged. State and sample are bounded
by parameters, so neither grows with the table. Scoring covers every row.

Defined results: an empty or null text has no feature and scores 0.5. Labels that
are null, or that differ for one identifier, are left out. Rows with a null
identifier are scored, never learnt from. Without a single usable label every
score is 0.5. All columns of the input are kept; the score may be given another name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import lean, materialize, slices
from cloakframe.runtime import discard

BITS = 18
#: Pieces of words that a task remembers; beyond it starts afresh.
CACHE_WORDS = 200_000
#: A text with a score below this is rejected.
KEEP_SCORE = 0.3
_PIECE = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")
_SPREAD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_REPEAT = np.uint64(0x165667B19E3779F9)


class _Pieces(dict):
    """Word -> hashes of its pieces, worked out once."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = self[word] = tuple(zlib.crc32(p) for p in _PIECE.findall(word))
        return found


_pieces = _Pieces()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and their values (unit length)."""
    if len(_pieces) > CACHE_WORDS:
        _pieces.clear()
    words = (text or "").encode("utf-8", "surrogatepass").split()
    ids = np.fromiter(chain.from_iterable(map(_pieces.__getitem__, words)), np.uint64)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0)
    same = int(np.count_nonzero(ids[1:] == ids[:-1]))
    shift = np.uint64(64 - BITS)
    hashed = np.concatenate(
        [ids * _SPREAD, (ids[:-1] * _PAIR + ids[1:]) * _SPREAD, np.full(same, _REPEAT)]
    )
    found, counts = np.unique((hashed >> shift).astype(np.int32), return_counts=True)
    # sum of (square root of count) squared is the number of occurrences
    return found.astype(np.int64), np.sqrt(counts / len(hashed))


def _weights(z, n, rate, smooth, l1, l2):
    pulled = np.where(np.abs(z) <= l1, 0.0, z - np.sign(z) * l1)
    return -pulled / ((smooth + np.sqrt(n)) / rate + l2)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def _average(shards: pd.DataFrame) -> pd.DataFrame:
    """Mean of the shards' states, by their numbers of rows."""
    share = shards["n_rows"].to_numpy() / shards["n_rows"].sum()
    mean = sum(np.frombuffer(s) * part for s, part in zip(shards["state"], share))
    return pd.DataFrame({"state": [mean.tobytes()]})


def fit(
    labelled: DataFrame,
    text_col: str,
    label_col: str,
    order_col: str,
    shards: int = 6,
    epochs: int = 4,
    rate: float = 2.0,
    smooth: float = 1.0,
    l1: float = 0.01,
    l2: float = 1e-3,
) -> np.ndarray:
    """Weights for the 2**BITS features from rows of text and 0/1 label.

    ``order_col`` (a hash) deals rows to shards and orders them, so the result
    depends on the rows alone.
    """

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("at"),
                    part.column("y"),
                    pa.array([f.astype(np.int32) for f, _ in made], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32())),
                ],
                ["at", "y", "f", "v"],
            )
        _pieces.clear()  # the worker goes on, with other work

    rows = labelled.select(
        F.col(order_col).alias("at"),
        F.col(label_col).cast("double").alias("y"),
        F.col(text_col).alias("text"),
    )
    schema = "at long, y double, f array<int>, v array<float>"
    table = materialize(rows.mapInArrow(lean(featurize), schema), "quality-features")
    size = 1 << BITS
    state = np.zeros((2, size))
    spark = labelled.sparkSession

    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(state)

        def follow(rows: pd.DataFrame) -> pd.DataFrame:
            z, n = shared.value.copy()
            ys, fs, vs = rows["y"].to_numpy(), rows["f"].to_list(), rows["v"].to_list()
            order = np.lexsort((ys, rows["at"].to_numpy() * (2 * epoch + 1)))
            for i in order:
                f, v = np.asarray(fs[i], np.int64), np.asarray(vs[i], np.float64)
                if not len(f):
                    continue
                w = _weights(z[f], n[f], rate, smooth, l1, l2)
                g = (_sigmoid(float(w @ v)) - ys[i]) * v
                grown = np.sqrt(n[f] + g * g)
                z[f] += g - (grown - np.sqrt(n[f])) / rate * w
                n[f] += g * g
            return pd.DataFrame({"n_rows": [len(rows)], "state": [np.stack([z, n]).tobytes()]})

        shard = F.pmod(F.col("at"), F.lit(shards)).cast("int")
        followed = table.withColumn("shard", shard).groupBy("shard").applyInPandas(
            follow, "n_rows long, state binary"
        )
        # One row for each shard: averaged in a task, so that the driver gets one state.
        made = followed.groupBy().applyInPandas(_average, "state binary").collect()
        shared.destroy()
        if not made:
            break
        state = np.frombuffer(made[0]["state"]).reshape(2, size).copy()
        del made
    discard(table)
    return _weights(state[0], state[1], rate, smooth, l1, l2)


def held_out(id_col: str) -> Column:
    """Rows to test on: crc32 of the identifier's text leaves no rest by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_rows: int = 20_000,
) -> DataFrame:
    """(text, y, at) of at most about ``max_rows`` labelled documents.

    ``labels`` and ``docs`` share ``doc_id``. Rows are kept by a hash of the
    identifier, at a share that follows from the number of labels; the sample's
    identifiers (bounded by ``max_rows``) are broadcast to the documents.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("top"))
        .where(F.col("y") == F.col("top"))
        .select("doc_id", "y", F.xxhash64("doc_id").alias("at"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    # 40 bits of the hash: a share of very many labels still keeps some.
    place = F.pmod("at", F.lit(1 << 20)) * (1 << 20) + F.pmod(F.shiftright("at", 20), F.lit(1 << 20))
    kept = known.where(place < F.lit(int(share * (1 << 40))))
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(kept), "doc_id")
        .select("text", "y", F.xxhash64("at", F.lit(7)).alias("at"))
    )


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability of label 1."""
    if name in docs.columns:
        raise ValueError(f"the input has a column {name!r}; give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in slices(batches):
            made = (features(t) for t in part.column(names.index(text_col)).to_pylist())
            scores = [float(_sigmoid(float(w[f] @ v))) for f, v in made]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64())], [*names, name]
            )
        _pieces.clear()

    return docs.mapInArrow(lean(apply), T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))
