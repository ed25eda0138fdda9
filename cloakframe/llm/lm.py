"""Language-model scoring by cross-entropy difference.

Two n-gram models are matched: both are over the bytes of the texts, which is one
vocabulary without unknown tokens, have the same order and the same smoothing. The
background model counts all documents, the target model those that are marked. A
document's score is the mean over its bytes of

    loss under the target model - loss under the background model

so the lower the score, the more the document is like the target.

Counting is exact and over all documents. The table is cut into *chunks* of bounded
size; a chunk sends each distinct n-gram once, with its counts. The n-gram table is
a distributed table that grows with the corpus: it is never broadcast or collected.
Lower orders are sums over it. Each chunk then gets back the losses of its own
n-grams, one row for each, and scores its documents in place. Chunks are buckets of
a written table, so the texts are not shuffled for that.

Smoothing is Witten-Bell's: with c the count of a byte after a context, N the
count of the context and u the number of different bytes after it,

    P(byte | context) = (c + u * P(byte | shorter context)) / (N + u)

from 1/256 without context; a context that a model has not seen passes on the
shorter one's probability. Texts are preceded by zero bytes.

Defined results: a null or empty text has no token and score 0; repeated rows count
and are scored each time; a null mark is no target; without any target the target
model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import materialize, slices, workers
from cloakframe.runtime import materialize_bucketed

ORDER = 5
#: Bytes of text in a chunk, and of those looked at at a time.
CHUNK_BYTES, STEP_BYTES = 16 << 20, 1 << 19


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the n-gram that ends at each byte of the texts, number of bytes per text)."""
    pad = bytes(order - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gram = np.zeros(max(0, len(data) - order + 1), np.int64)
    for i in range(order):
        gram = (gram << 8) | data[i : i + len(gram)]
    # the n-grams that end in the zero bytes between texts are none
    own = np.ones(len(gram), bool)
    ends = np.cumsum(sizes)[:-1] + np.arange(len(sizes) - 1) * (order - 1) if len(sizes) else np.zeros(0, np.int64)
    for k in range(order - 1):
        own[ends + k] = False
    return gram[own], sizes


def chunked(docs: DataFrame, text_col: str, keep: list[str], target: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents in chunks, as a table bucketed by chunk."""
    kept = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
        F.coalesce(F.col(target).cast("boolean"), F.lit(False)).alias("_target"),
        *keep,
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, 64):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([chunk] * part.num_rows, pa.int64())], [*part.schema.names, "_chunk"]
            )
            held += part.column(0).nbytes
            if held >= chunk_bytes:
                chunk, held = chunk + 1, 0

    made = kept.mapInArrow(number, T.StructType([*kept.schema, T.StructField("_chunk", T.LongType())]))
    return materialize_bucketed(made, "chunks", workers(docs), "_chunk")


def _steps(texts: list[bytes]) -> Iterator[slice]:
    """Consecutive texts of about STEP_BYTES."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP_BYTES or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, size = i + 1, 0


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(np.concatenate(keys))
    joined = np.concatenate(counts, axis=1)
    return found, np.stack([np.bincount(codes, c, len(found)) for c in joined])


def chunk_counts(chunks: DataFrame, order: int = ORDER) -> DataFrame:
    """(chunk, gram, background, target): counts of the n-grams of each chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "gram", "background", "target"]
        chunk, keys, counts = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                found, both = _merge(keys, counts)
                for at in range(0, len(found), 50_000):
                    some = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(found[some]), chunk, np.int64)),
                            pa.array(found[some]),
                            pa.array(both[0][some].astype(np.int64)),
                            pa.array(both[1][some].astype(np.int64)),
                        ],
                        names,
                    )

        for part in slices(batches, 512):
            ids = part.column(2).to_numpy()
            texts, marks = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
            for one in dict.fromkeys(ids.tolist()):
                if one != chunk:
                    yield from out()
                    chunk, keys, counts = one, [], []
                there = np.flatnonzero(ids == one)
                own = [texts[i] for i in there.tolist()]
                for some in _steps(own):
                    gram, sizes = grams(own[some], order)
                    codes, found = pd.factorize(gram)
                    marked = np.repeat(marks[there[some]].astype(np.float64), sizes)
                    keys.append(found)
                    counts.append(np.stack([np.bincount(codes, minlength=len(found)), np.bincount(codes, marked, len(found))]))
                if len(keys) > 16:
                    found, both = _merge(keys, counts)
                    keys, counts = [found], [both]
        yield from out()

    rows = chunks.select("_text", "_target", "_chunk")
    return rows.mapInArrow(count, "chunk long, gram long, background long, target long")


def losses(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, background, target): natural-log losses of the n-grams' last bytes."""
    models = ("background", "target")
    total = counts.groupBy("gram").agg(*[F.sum(m).alias(m) for m in models])
    total = materialize(total, "grams")
    shorter = None
    for n in range(1, order + 1):
        rows = total
        if n < order:
            rows = total.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(
                *[F.sum(m).alias(m) for m in models]
            )
        rows = rows.withColumn("context", F.shiftright("gram", 8))
        seen = rows.groupBy("context").agg(
            *[F.sum(m).alias(f"n_{m}") for m in models],
            *[F.count_if(F.col(m) > 0).alias(f"u_{m}") for m in models],
        )
        rows = rows.join(seen, "context")
        if shorter is None:
            rows = rows.withColumns({f"q_{m}": F.lit(1 / 256) for m in models})
        else:
            tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
            rows = rows.withColumn("tail", tail).join(shorter, "tail")
        mixed = {
            m: F.when(F.col(f"n_{m}") == 0, F.col(f"q_{m}")).otherwise(
                (F.col(m) + F.col(f"u_{m}") * F.col(f"q_{m}")) / (F.col(f"n_{m}") + F.col(f"u_{m}"))
            )
            for m in models
        }
        made = rows.select("gram", *[mixed[m].alias(m) for m in models])
        if n < order:
            made = materialize(made, f"probabilities-{n}")
            shorter = made.select(F.col("gram").alias("tail"), *[F.col(m).alias(f"q_{m}") for m in models])
    return made.select("gram", *[(-F.log(m)).cast("float").alias(m) for m in models])


def cross_entropy_difference(
    docs: DataFrame, target: str, keep: list[str], text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The ``keep`` columns with n_tokens, target_loss, background_loss and score.

    ``target`` is a boolean column that marks the target's documents. Losses are
    means per byte; score = target_loss - background_loss.
    """
    results = ["n_tokens", "target_loss", "background_loss", "score"]
    if bad := set(keep) & {*results, "_text", "_target", "_chunk"}:
        raise ValueError(f"rename the columns {sorted(bad)}")
    if not 1 <= order <= 7:
        raise ValueError("orders are from 1 to 7")
    chunks = chunked(docs, text_col, keep, target, chunk_bytes)
    counts = materialize(chunk_counts(chunks, order), "chunk-counts")
    wanted = counts.select("chunk", "gram").join(losses(counts, order), "gram")
    wanted = wanted.select(F.col("chunk").alias("_chunk"), "gram", "background", "target")

    def score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        model = model.drop_duplicates("gram")
        index = pd.Index(model["gram"].to_numpy())
        loss = model[["target", "background"]].to_numpy(np.float64)
        texts, sums = [bytes(t) for t in rows["_text"]], []
        for some in _steps(texts):
            gram, sizes = grams(texts[some], order)
            running = np.concatenate([np.zeros((1, 2)), np.cumsum(loss[index.get_indexer(gram)], axis=0)])
            ends = np.cumsum(sizes)
            sums.append(running[ends] - running[ends - sizes])
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        mean = np.concatenate([*sums, np.zeros((0, 2))]) / np.maximum(n, 1)[:, None]
        out = rows[keep].copy()
        out["n_tokens"], out["target_loss"], out["background_loss"] = n, mean[:, 0], mean[:, 1]
        out["score"] = mean[:, 0] - mean[:, 1]
        return out

    fields = [chunks.schema[c] for c in keep]
    kinds = [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(results, kinds))])
    return chunks.groupBy("_chunk").cogroup(wanted.groupBy("_chunk")).applyInPandas(score, schema)
