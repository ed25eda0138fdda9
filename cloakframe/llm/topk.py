"""Exact top-k inner-product search over an impact-ordered index, score at a time.

The index holds blocks of vectors. Of each block and dimension it keeps posting
segments: the vectors whose component has a certain quantised impact (the bit
length of its size: impact i holds sizes from 2**(i-1) to 2**i - 1), with the
components. A query meets a block's segments in descending impact. After each
impact the score of every vector is known up to what is left, which is at most

    sum over dimensions of |query component| * largest component left there,

so a vector whose upper bound lies below the k-th best lower bound is out, for
good. A block is left when that holds for all of its vectors but those that the
k-th best needs, and no sooner; what may still be in the result is scored again
from the whole vectors. Results are exact, ties go to the smaller identifier.

Queries go in groups against each block, so a group's impacts are matrix products.
Queries are a stated set; they are held against every block, in blocks on both
sides (a group is sent to each block), and each meeting passes on k rows a query.
The best k per query are taken in two steps, first over groups of blocks.

Components are integers. Where every sum of products stays below 2**53 the products
are taken in float64, which is exact, otherwise in 64-bit integers.

Defined results: vectors that are null or hold a null, and rows without an
identifier, are left out, as queries and as candidates, and so are vectors of
another length than the query's; repeated rows are candidates each; with fewer
than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import materialize
from cloakframe.runtime import small_side

#: Vectors in a block, queries in a group.
BLOCK_ROWS, GROUP_ROWS = 4096, 512
#: Dimensions, places and components of an impact's segments, as 64-bit numbers.
_INDEX = "block int, dims int, impact int, dim binary, place binary, value binary"


def _bytes(values) -> bytes:
    return np.asarray(values, "<i8").tobytes()


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def quantise(vector: str, scale: int = 64):
    """floor(scale * component) as integers; null if the vector, or a component, is
    null or not finite."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    made = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return F.when(F.coalesce(sound, F.lit(False)), made)


def _segments(rows: pd.DataFrame) -> pd.DataFrame:
    """Posting segments of one block; an impact's segments of all dimensions in a row."""
    block, dims = int(rows["block"].iloc[0]), int(rows["dims"].iloc[0])
    rows = rows.sort_values("place")
    matrix = np.stack(rows["vector"].to_list()).astype(np.int64) if dims else np.zeros((len(rows), 0), np.int64)
    impacts = np.frexp(np.abs(matrix).astype(np.float64))[1].astype(np.int64)
    out = []
    for impact in np.unique(impacts[impacts > 0])[::-1].tolist():
        dim, place = np.nonzero(impacts.T == impact)  # by dimension
        out.append((block, dims, impact, _bytes(dim), _bytes(place), _bytes(matrix[place, dim])))
    # impact 0 has no posting; the row says that the block is there
    out.append((block, dims, 0, b"", b"", b""))
    return pd.DataFrame(out, columns=["block", "dims", "impact", "dim", "place", "value"])


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(segments, identifiers) of ``vectors(id, vector array<long>)``, both written.

    Rows are dealt to blocks by a number that follows their place in the input, so
    blocks have about ``block_rows`` rows whatever the values are.
    """
    usable = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector")
    rows = materialize(usable.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
    rows = rows.select("id", "vector", "_row", block.alias("block"), F.size("vector").alias("dims"))
    spot = F.row_number().over(Window.partitionBy("block", "dims").orderBy("_row")) - 1
    rows = materialize(rows.withColumn("place", spot), "placed-vectors")
    segments = rows.groupBy("block", "dims").applyInPandas(_segments, _INDEX)
    ids = rows.groupBy("block", "dims").agg(
        F.array_sort(F.collect_list(F.struct("place", "id"))).alias("held")
    )
    ids = ids.select("block", "dims", F.col("held.id").alias("ids"))
    return materialize(segments, "segments"), materialize(ids, "segment-ids")


def search_block(
    queries: np.ndarray, own: list[list[int]], ids: np.ndarray, segments: list[tuple], k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, identifiers, scores): each query's best k of one block.

    ``segments``: (impact, dim, place, value) in descending impact. ``own``: the
    places in the block that are the query itself.
    """
    n, dims = len(ids), queries.shape[1]
    top = max((int(np.abs(v).max()) for *_, v in segments), default=0)
    small = dims * top * int(np.abs(queries).max(initial=0)) < 1 << 53
    kind = np.float64 if small else np.int64
    queries = queries.astype(kind)
    scores, full = np.zeros((len(queries), n), kind), np.zeros((n, dims), kind)
    # largest size of a component of each dimension from a segment on
    later = np.zeros((len(segments) + 1, dims), kind)
    for i in range(len(segments) - 1, -1, -1):
        _, dim, _, value = segments[i]
        later[i] = later[i + 1]
        np.maximum.at(later[i], dim, np.abs(value))
    for dim_values in segments:
        full[dim_values[2], dim_values[1]] = dim_values[3]
    sizes = np.abs(queries)
    active = np.arange(len(queries))
    done: dict[int, np.ndarray] = {}
    want = min(n, k + max((len(o) for o in own), default=0))
    for i, (_, dim, place, value) in enumerate(segments):
        layer = np.zeros((n, dims), kind)
        layer[place, dim] = value
        scores[active] += queries[active] @ layer.T
        left = sizes[active] @ later[i + 1]
        if want == n or not len(active):
            continue
        # lower bounds are scores - left, upper bounds scores + left
        worst = np.partition(scores[active], n - want, axis=1)[:, n - want] - left
        possible = scores[active] + left[:, None] >= worst[:, None]
        counts = possible.sum(axis=1)
        # proof: all others are out; few enough are left to score them again
        settled = counts <= max(want, 4 * k)
        for j in np.flatnonzero(settled).tolist():
            done[int(active[j])] = np.flatnonzero(possible[j])
        active = active[~settled]
    everything = np.arange(n)
    for q in range(len(queries)):
        members = done.get(q, everything)
        if own[q]:
            members = members[~np.isin(members, own[q])]
        exact = (full[members] @ queries[q]).astype(np.int64)
        order = np.lexsort((ids[members], -exact))[:k]
        yield q, ids[members][order], exact[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query.

    ``vectors(id, vector array<long>)`` are the candidates, ``queries`` of the same
    form the queries; a candidate with the query's identifier is left out. Every row
    of ``queries`` gets its own k rows, also where an identifier is asked twice; a
    repeated candidate takes a place for each of its rows.
    """
    segments, ids = build_index(vectors, block_rows)
    usable = queries.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector")
    asked = materialize(usable.withColumn("ask", F.monotonically_increasing_id()), "queries")
    groups = max(1, -(-asked.count() // group_rows))
    asked = asked.select("*", F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int").alias("group"), F.size("vector").alias("dims"))

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(rows["vector"].to_list()).astype(np.int64)
        made = (int(rows["dims"].iloc[0]), rows["ask"].to_list(), rows["id"].to_list(), _bytes(matrix))
        return pd.DataFrame([made], columns=["dims", "asks", "asked", "matrix"])

    bundles = asked.groupBy("group", "dims").applyInPandas(bundle, "dims int, asks array<long>, asked array<long>, matrix binary")
    here = ids.select("block", "dims")
    # a stated query set, in groups: each is sent to every block of its length
    sent = bundles.join(small_side(here, here.count(), 16), "dims")
    index = segments.groupBy("block", "dims").agg(
        F.collect_list(F.struct("impact", "dim", "place", "value")).alias("segments")
    ).join(ids, ["block", "dims"])
    meetings = sent.join(index, ["block", "dims"]).select("block", "dims", "asks", "asked", "matrix", "ids", "segments")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples(index=False):
                held = sorted(row.segments, key=lambda s: -s["impact"])
                held = [(s["impact"], *(_ints(s[c]) for c in ("dim", "place", "value"))) for s in held if s["impact"]]
                block_ids = np.asarray(row.ids, np.int64)
                where: dict[int, list[int]] = {}
                for p, one in enumerate(block_ids.tolist()):
                    where.setdefault(one, []).append(p)
                asks, asked_ids = list(row.asks), list(row.asked)
                matrix = _ints(row.matrix).reshape(len(asked_ids), row.dims)
                own = [where.get(i, []) for i in asked_ids]
                yield pd.concat(
                    pd.DataFrame({"ask": asks[q], "query_id": asked_ids[q], "block": row.block, "vec_id": found, "score": score})
                    for q, found, score in search_block(matrix, own, block_ids, held, k)
                )

    found = meetings.mapInPandas(search, "ask long, query_id long, block int, vec_id long, score long")
    best = [F.col("score").desc(), F.col("vec_id")]
    some = F.row_number().over(Window.partitionBy("ask", "some").orderBy(*best))
    found = found.withColumn("some", F.pmod("block", F.lit(64))).withColumn("n", some).where(F.col("n") <= k)
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(*best))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
