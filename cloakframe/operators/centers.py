"""Class centres: clustering, capacity-limited assignment, seeding."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tie_key
from ..runtime import discard, materialize, small_side
from .boxtree import MAX_DIMENSIONS, build_tree, search_tree, set_limit
from .nearest import build_index, nearest_center, search
from .ranking import CELL_ROWS, rank_within

__all__ = [
    "Matching",
    "class_centers",
    "class_centers_kmeans",
    "class_centers_random",
    "match_to_centers",
    "nearest_center",
    "redistribute_by_center",
    "seed_centers_mixed",
]

#: Classes that may each have a centre of one k-means model: all of them live on the driver,
#: whose seeding takes a time that grows with their square.
MAX_CENTERS = 1 << 10
#: Up to so many classes a coordinate without a number is an error, as the model has it.
WHOLE_CENTERS = 1 << 16
#: Clusters that one group seeds, and sampled rows for each.
GROUP_CLUSTERS, SEED_ROWS = 1000, 8
#: Contests whose holders are read one by one before they are written as one table.
OPEN_CONTESTS = 6
#: Waiting rows, and open classes, of a bucket that one task finishes alone.
LOCAL_ROWS = 200_000
#: Rows, and classes, of a bucket that one task matches alone.
MATCH_ROWS = 500_000
#: Classes that equal rows of a bucket ask in one round there.
ASKED = 64


def draw(pid: Column, seed: int, step: int = 0) -> Column:
    """A number in [0, 1) drawn by the MD5 of an identifier: 13 of its hex digits."""
    text = F.concat_ws("/", pid.cast("string"), F.lit(str(seed)), F.lit(str(step)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _rank_by_size(class_sizes: DataFrame, classes: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Classes numbered from 0 by size, largest first, then by their number."""
    keyed = class_sizes.select("ec", "size").withColumns(
        {"__key": -F.col("size"), "__tie": F.lpad(F.hex("ec"), 16, "0")}
    )
    ranked = rank_within(keyed, [], "__key", "__tie", classes, "__rn", cell_rows)
    return ranked.select("ec", "size", (F.col("__rn") - 1).alias("cluster"))


def class_centers_kmeans(
    df: DataFrame,
    columns: Sequence[str],
    class_sizes: DataFrame,
    seed: int = 123456789,
    random: bool = False,
    strict: bool = False,
    pid: str | None = None,
) -> DataFrame:
    """One centre per class: ``ec, size, cluster`` and the coordinates.

    k is the number of classes; one iteration from k-means|| (centre = mean of
    the members) or from random rows (the model's centres). The i-th cluster
    found goes to the i-th largest class. A clustering may find fewer clusters
    than classes (with few distinct rows, or an empty cluster); the classes
    left over get the mean of the table, or with ``strict`` it is an error. As
    many centres as classes live on the driver; with an identifier ``pid``, or for
    more than ``MAX_CENTERS`` classes, see :func:`class_centers`.
    """
    columns = list(columns)
    class_sizes = materialize(class_sizes.select("ec", "size"), "class-sizes")
    k = class_sizes.count()
    if pid or k > MAX_CENTERS:
        gap = " OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in columns)
        if not pid and k <= WHOLE_CENTERS and not df.where(gap).isEmpty():
            raise ValueError(f"null or NaN in {columns}")
        return class_centers(df, columns, class_sizes, pid, seed, random, strict)
    ranked = _rank_by_size(class_sizes, k)
    mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    listed: list[tuple] = []
    if k > 1:
        vectors = VectorAssembler(inputCols=columns, outputCol="__features").transform(
            df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        )
        model = KMeans(
            k=k,
            maxIter=1,
            seed=seed,
            initMode="random" if random else "k-means||",
            featuresCol="__features",
            predictionCol="cluster",
        ).fit(vectors)
        if random:
            listed = [tuple(map(float, c)) for c in model.clusterCenters()]
        else:
            members = model.transform(vectors).groupBy("cluster").agg(
                *[F.avg(c).alias(c) for c in columns]
            )
            listed = [tuple(r)[1:] for r in sorted(members.collect())]
        if strict and len(listed) < k:
            raise ValueError(f"{len(listed)} clusters for {k} classes")
    listed += [tuple(mean)] * (k - len(listed))
    schema = "cluster bigint, " + ", ".join(f"`{c}` double" for c in columns)
    numbered = [(i, *c) for i, c in enumerate(listed)]
    centers = df.sparkSession.createDataFrame(numbered, schema)
    return ranked.join(centers, "cluster").select("ec", "size", "cluster", *columns)


def class_centers_random(
    df: DataFrame, columns: Sequence[str], class_sizes: DataFrame, seed: int = 123456789, pid: str | None = None
) -> DataFrame:
    """:func:`class_centers_kmeans` from random rows."""
    return class_centers_kmeans(df, columns, class_sizes, seed, random=True, pid=pid)


def _coarse_cells(rows: DataFrame, columns: list[str], k: int, group_clusters: int) -> DataFrame:
    """Rows with the ``__cell`` they are clustered in and its number ``__k`` of clusters.

    Cells are the rows nearest to one of k / group_clusters drawn rows. A cell gets
    clusters in proportion to its rows (prefix sums rounded, so that they add up to
    k); one that gets more than ``group_clusters`` is cut by the rows' hashes.
    """
    wanted = math.ceil(k / group_clusters)
    if wanted == 1:
        return rows.withColumns({"__cell": F.lit("0"), "__k": F.lit(k).cast("bigint")})
    drawn = rows.orderBy("__draw", "__tie").limit(wanted)
    pivots = materialize(drawn.select(F.xxhash64("__tie").alias("__id"), *columns).dropDuplicates(columns), "pivots")
    near = materialize(nearest_center(rows, columns, pivots, "__id", name="__pivot", distance="__off"), "coarse")
    sizes = near.groupBy("__pivot").agg(F.count(F.lit(1)).alias("__n")).toPandas()  # a row per pivot
    upto = np.concatenate([[0], np.cumsum(sizes["__n"].to_numpy())])
    shares = np.diff([int(n) * k // int(upto[-1]) for n in upto.tolist()])
    cuts = np.maximum(1, -(-shares // group_clusters))
    parts = rows.sparkSession.createDataFrame(
        pd.DataFrame({"__pivot": sizes["__pivot"], "__share": shares, "__cuts": cuts}),
        "__pivot bigint, __share bigint, __cuts bigint",
    )
    placed = near.drop("__off").join(small_side(parts, len(sizes)), "__pivot")
    part = F.pmod(F.xxhash64("__tie"), F.col("__cuts"))
    # The first cuts of a cell get the clusters that do not divide evenly.
    own = F.expr("__share div __cuts") + F.when(part < F.pmod("__share", "__cuts"), 1).otherwise(0)
    cell = F.concat_ws("/", F.col("__pivot").cast("string"), part.cast("string"))
    return placed.withColumns({"__cell": cell, "__k": own.cast("bigint")}).drop("__pivot", "__share", "__cuts")


def _spread_seeds(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Places of k rows by k-means++: each drawn by its squared distance to the others."""
    taken = [int(rng.integers(len(points)))]
    cost = ((points - points[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < min(k, len(points)):
        total = np.cumsum(cost)
        if not total[-1] > 0:  # only copies are left, now and after any of them
            left = np.ones(len(points), bool)
            left[taken] = False
            taken += np.flatnonzero(left)[: min(k, len(points)) - len(taken)].tolist()
            break
        at = min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(points) - 1)
        taken.append(at)
        cost = np.minimum(cost, ((points - points[at]) ** 2).sum(axis=1))
    return np.array(taken)


def class_centers(
    df: DataFrame,
    columns: Sequence[str],
    class_sizes: DataFrame,
    pid: str | None = None,
    seed: int = 123456789,
    random: bool = False,
    strict: bool = False,
    group_clusters: int = GROUP_CLUSTERS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One centre per class for any number of classes: ``ec, size, cluster`` and the
    coordinates.

    Clusters are dealt out to coarse cells of rows (:func:`_coarse_cells`), and each
    cell seeds its own in its own group: with ``random`` the rows drawn first, else
    k-means++ on ``SEED_ROWS`` drawn rows per cluster. The seeds stay in a table. One
    k-means step moves them to the mean of the rows nearest to them (``random`` stops
    there); the centre is the mean of the members that these means have. Rows with a
    coordinate that is null or not finite take no part. Draws are made by the MD5 of
    ``pid`` (without one: of the coordinates), ties go to the smaller MD5.

    Clusters are numbered by the draw of their seed; the i-th goes to the i-th
    largest class. Classes left over get the mean of the table, or with ``strict``
    it is an error.
    """
    columns = list(columns)
    k = class_sizes.count()
    ranked = _rank_by_size(class_sizes, k)
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    name = F.col(pid).cast("string") if pid else F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    finite = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) < double('inf')" for c in columns)
    rows = df.select(*numbers, F.md5(name).alias("__tie"), draw(name, seed).alias("__draw")).where(finite)
    rows = materialize(rows, "points")
    many = rows.count()
    if not k or not many:
        none = [F.lit(None).cast("double").alias(c) for c in columns]
        return ranked.select("ec", "size", "cluster", *none)
    cells = materialize(_coarse_cells(rows, columns, min(k, many), group_clusters), "cells")
    ordered = rank_within(cells, ["__cell"], "__draw", "__tie", many, "__rn", cell_rows)
    if random:
        seeds = ordered.where("__rn <= __k").select("__draw", "__tie", *columns)
    else:
        some = ordered.where(F.col("__rn") <= SEED_ROWS * F.col("__k"))

        def spread(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["__draw", "__tie"], ignore_index=True)
            rng = np.random.default_rng(zlib.crc32(f"{group['__cell'][0]}/{seed}".encode()))
            return group.iloc[_spread_seeds(group[columns].to_numpy(), int(group["__k"][0]), rng)][kept]

        kept = ["__draw", "__tie", *columns]
        schema = "__draw double, __tie string, " + ", ".join(f"`{c}` double" for c in columns)
        seeds = some.groupBy("__cell").applyInPandas(spread, schema)
    means = rank_within(materialize(seeds, "seeds"), [], "__draw", "__tie", k, "__rn", cell_rows)
    means = materialize(means.select((F.col("__rn") - 1).alias("cluster"), *columns), "means")
    for step in range(1 if random else 2):
        near = nearest_center(rows.select(*columns), columns, means, "cluster", name="cluster", distance="__off")
        moved = near.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])
        if random:  # a model keeps the seed of a cluster that nothing is nearest to
            own = [F.coalesce(moved[c], means[c]).alias(c) for c in columns]
            moved = means.join(moved, "cluster", "left").select("cluster", *own)
        means = materialize(moved, f"means-{step}")
    found = rank_within(
        means.withColumns({"__key": F.col("cluster"), "__tie": F.lpad(F.hex("cluster"), 16, "0")}),
        [], "__key", "__tie", k, "__rn", cell_rows,
    ).select((F.col("__rn") - 1).alias("cluster"), *columns)
    if strict and found.count() < k:
        raise ValueError(f"{found.count()} clusters for {k} classes")
    mean = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    both = ranked.join(found, "cluster", "left")
    return both.select("ec", "size", "cluster", *[F.coalesce(F.col(c), F.lit(mean[c])).alias(c) for c in columns])


def redistribute_by_center(
    df: DataFrame,
    columns: Sequence[str],
    pid: str,
    centers: DataFrame,
    capacities: DataFrame,
    cell_rows: int = CELL_ROWS,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Capacity-limited assignment to the nearest class centre (the plain rule:
    no penalty for other columns, ties to the smaller class).

    ``df`` has a ``bucket``; ``centers`` has ``ec`` and ``columns``;
    ``capacities`` has ``ec, bucket, size``. In a round every waiting row
    proposes to the nearest class that still has room for its bucket; the
    closest rows win, the others try again. Every round fills a class or
    places every row, and the losers are a flag of the ranking, not an anti
    join. Waiting rows are written between rounds.

    Buckets do not share room. Once none has more than ``local_rows`` waiting rows
    or open classes, a task finishes each, by the same rounds: the last ones, which
    place few rows each, are no jobs of their own.
    """
    columns = list(columns)
    open_ = capacities.where(F.col("size") > 0).select("ec", "bucket", F.col("size").alias("room"))
    room = materialize(open_, "room")
    middle = materialize(centers.select("ec", *columns), "class-centers")
    waiting = materialize(df, "waiting")
    placed: list[DataFrame] = []
    rows = waiting.count()
    while rows:
        open_centers = room.where(F.col("room") > 0).join(middle, "ec")
        most = max(
            table.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0 for table in (waiting, open_centers)
        )
        if most <= local_rows:
            last = materialize(_fill_in_tasks(waiting, columns, pid, open_centers), "last-rounds")
            if not last.where("ec IS NULL").isEmpty():
                raise ValueError("the capacities do not cover the rows")
            placed.append(last)
            break
        proposed = nearest_center(
            waiting, columns, open_centers, "ec", group="bucket", name="ec", distance="__d"
        ).withColumn("__tie", tie_key(F.col(pid)))
        ranked = rank_within(
            proposed, ["ec", "bucket"], "__d", "__tie", rows, "__rn", cell_rows
        )
        spots = room.count()
        decided = materialize(
            ranked.join(small_side(room, spots), ["ec", "bucket"], "left").withColumn(
                "__won", F.coalesce(F.col("__rn") <= F.col("room"), F.lit(False))
            ),
            "proposals",
        )
        won = decided.where("__won")
        taken = won.groupBy("ec", "bucket").agg(F.count(F.lit(1)).alias("__taken"))
        room = materialize(
            room.join(taken, ["ec", "bucket"], "left").select(
                "ec", "bucket", (F.col("room") - F.coalesce("__taken", F.lit(0))).alias("room")
            ),
            "room",
        )
        placed.append(won.select(*df.columns, "ec"))
        waiting = decided.where(~F.col("__won")).select(*df.columns)
        left = waiting.count()
        if left == rows:
            raise ValueError("the capacities do not cover the rows")
        rows = left
    if not placed:
        return waiting.withColumn("ec", F.lit(None).cast("bigint"))
    return reduce(DataFrame.unionByName, placed)


def _fill(
    points: list[np.ndarray], ties: np.ndarray, ids: np.ndarray, middle: list[np.ndarray], room: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the classes of one bucket's rows, and which rows have none.

    The rounds of :func:`redistribute_by_center`: a class that turns rows away is
    full, so only those look again.
    """
    classes, first, of = np.unique(ids, return_index=True, return_inverse=True)
    room, out = room[first].copy(), np.full(len(ties), -1)
    rank = np.argsort(np.argsort(ties, kind="stable"), kind="stable")
    waiting = np.arange(len(ties))
    while len(waiting):
        open_ = room[of] > 0
        found, off = search(build_index(ids[open_], [c[open_] for c in middle]), [c[waiting] for c in points])[:2]
        asks = np.isfinite(off)
        if not asks.any():
            break
        waiting, at, off = waiting[asks], np.searchsorted(classes, found[asks]), off[asks]
        order = np.lexsort((rank[waiting], off, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        won = np.zeros(len(at), bool)
        won[order] = place < room[at[order]]
        out[waiting[won]] = at[won]
        np.subtract.at(room, at[won], 1)
        waiting = waiting[~won]
    none = out < 0
    return np.where(none, 0, classes[out] if len(classes) else 0), none


def _fill_in_tasks(waiting: DataFrame, columns: list[str], pid: str, open_centers: DataFrame) -> DataFrame:
    """``waiting`` with the ``ec`` that :func:`_fill` finds in each bucket, null without one."""
    names = [f"__at{i}" for i in range(len(columns))]
    rows = waiting.withColumns({n: F.col(c).cast("double") for n, c in zip(names, columns)})
    rows = rows.withColumn("__tie", tie_key(F.col(pid)))
    middle = open_centers.select(
        "bucket", F.col("ec").cast("bigint").alias("ec"), "room",
        *[F.col(c).cast("double").alias(n) for n, c in zip(names, columns)],
    )
    kept = waiting.columns
    schema = T.StructType([*waiting.schema, T.StructField("ec", T.LongType())])

    def finish(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        def column(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).to_pandas().to_numpy()

        ties = mine.column("__tie").to_pandas().fillna("").to_numpy()  # a null comes first
        points, places = ([column(t, n) for n in names] for t in (mine, theirs))
        found, none = _fill(points, ties, column(theirs, "ec"), places, column(theirs, "room"))
        return mine.select(kept).append_column("ec", pa.array(found, pa.int64(), mask=none))

    return rows.groupBy("bucket").cogroup(middle.groupBy("bucket")).applyInArrow(finish, schema)


class Matching(NamedTuple):
    """Assigned rows (with ``ec`` and ``distance``), and the rounds it took."""

    rows: DataFrame
    rounds: int


def _match(
    points: list[np.ndarray], ties: np.ndarray, ids: np.ndarray, middle: list[np.ndarray], room: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the classes of one bucket's rows and the squared distances (infinite
    without a class), and the rounds of :func:`match_to_centers` that it took.

    Rows with equal coordinates prefer the classes in one order, and every class prefers
    them in the order of their ties. So a class that as many of them ask as it has room
    for turns away all that come later: these ask the next one in the same round.
    """
    order = np.argsort(ids, kind="stable")
    ids, middle, room = ids[order], [c[order] for c in middle], room[order]
    most, last = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    tree = build_tree(np.arange(len(ids)), middle, limit=(most, last))
    order = np.lexsort((ties, *points))
    fresh = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in points])
    spot = np.cumsum(np.r_[True, fresh])[: len(order)]
    points, ties = [c[order] for c in points], ties[order]  # equal rows lie together, by their ties
    held, far = np.full(len(ties), -1), np.full(len(ties), np.inf)
    waiting, rounds, stuck = np.arange(len(ties)), 0, False
    while len(waiting) and not stuck:
        rounds += 1
        ends = np.flatnonzero(np.r_[spot[waiting][1:] != spot[waiting][:-1], True]) + 1
        next_ = np.r_[0, ends[:-1]]
        passed = None
        for step in range(ASKED):
            asks = waiting[next_]
            found, off, _ = search_tree(tree, [c[asks] for c in points], tie=ties[asks], after=passed)
            some = np.isfinite(off)
            if not step and not some.all():
                stuck = True
            next_, ends, found, off = next_[some], ends[some], found[some], off[some]
            # At the distance of the limit the tie decides for each row.
            even = off == most[found]
            take = np.where(even, 1, np.minimum(room[found], ends - next_))
            upto = np.cumsum(take)
            dealt = waiting[np.repeat(next_ - upto + take, take) + np.arange(upto[-1] if len(upto) else 0)]
            held[dealt], far[dealt] = np.repeat(found, take), np.repeat(off, take)
            go = (next_ + take < ends) & ~even
            if not go.any():
                break
            next_, ends, passed = (next_ + take)[go], ends[go], (off[go], found[go])
        touched = np.zeros(len(ids) + 1, bool)
        touched[held[waiting]] = True
        touched[-1] = False
        rivals = np.flatnonzero(touched[held])
        rivals = rivals[np.lexsort((ties[rivals], far[rivals], held[rivals]))]
        at = held[rivals]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        lost, farthest = rivals[place >= room[at]], rivals[place == room[at] - 1]
        full = held[farthest]
        most[full], last[full] = far[farthest], ties[farthest]
        set_limit(tree, most, last, full)
        held[lost], far[lost] = -1, np.inf
        waiting = np.sort(np.concatenate([waiting[held[waiting] < 0], lost[~np.isin(lost, waiting)]]))
    out, dist = np.empty_like(held), np.empty_like(far)
    out[order], dist[order] = ids[held] if len(ids) else held, far
    return out, dist, rounds


def _match_in_tasks(waiting: DataFrame, columns: list[str], seats: DataFrame) -> DataFrame:
    """``__pid, ec, __d, __rounds`` by :func:`_match` in each bucket; ``ec`` is null for a row
    that has no distance to any class."""
    names = [f"__at{i}" for i in range(len(columns))]
    numbers = [F.col(c).cast("double").alias(n) for n, c in zip(names, columns)]
    mine = waiting.select("__pid", "bucket", F.coalesce("__tie", F.lit(-1)).alias("__tie"), *numbers)
    theirs = seats.select("bucket", F.col("ec").cast("bigint").alias("ec"), "room", *numbers)
    schema = T.StructType(
        [waiting.schema["__pid"], T.StructField("ec", T.LongType()), T.StructField("__d", T.DoubleType()), T.StructField("__rounds", T.IntegerType())]
    )

    def match(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        def column(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).to_pandas().to_numpy()

        points, places = ([column(t, n).astype(np.float64) for n in names] for t in (mine, theirs))
        found, far, rounds = _match(points, column(mine, "__tie"), column(theirs, "ec"), places, column(theirs, "room"))
        none = ~np.isfinite(far)
        made = [pa.array(found, pa.int64(), mask=none), pa.array(far, pa.float64(), mask=none), pa.array(np.full(len(far), rounds), pa.int32())]
        return pa.table([mine.column("__pid"), *made], names=["__pid", "ec", "__d", "__rounds"])

    return mine.groupBy("bucket").cogroup(theirs.groupBy("bucket")).applyInArrow(match, schema)


def match_to_centers(
    df: DataFrame,
    columns: Sequence[str],
    pid: str,
    centers: DataFrame,
    capacities: DataFrame,
    cell_rows: int = CELL_ROWS,
    local_rows: int = MATCH_ROWS,
) -> Matching:
    """Capacity-limited assignment in which no row and class would rather have each
    other: of all waiting rows and open classes, the closest pair is joined first.

    Deferred acceptance: every waiting row proposes to the nearest class that would
    take it; a class keeps the closest rows of its bucket so far, up to its
    capacity, and turns the others away, also rows that it held. A full class
    takes only what is closer than the farthest row it holds, and a row turned away
    passes over all classes that would not take it; so the rounds grow with the
    depth of the rows' preferences, not with the number of classes. Equal distances
    are ordered by the class number for a row, and for a class by the MD5 of the
    identifier (its first 60 bits).

    ``df`` has a ``bucket``; ``centers`` has ``ec`` and ``columns``; ``capacities``
    has ``ec, bucket, size``. A round writes the rows of the classes that it touches;
    the classes' limits are a table of their own. Capacities that do not cover the
    rows are an error, as are coordinates that are null or not finite.

    Buckets do not share room. One with at most ``local_rows`` rows and open classes is
    matched by one task, by the same rounds; only those of larger buckets are jobs.
    """
    columns = list(columns)
    room = capacities.where(F.col("size") > 0).select("ec", "bucket", F.col("size").cast("bigint").alias("room"))
    seats = materialize(
        room.join(centers.select("ec", *columns), "ec").withColumns(
            {"__most": F.lit(float("inf")), "__last": F.lit(0).cast("bigint"), "__round": F.lit(0)}
        ),
        "seats",
    )
    spots = seats.count()
    key = F.conv(F.substring(tie_key(F.col(pid)), 1, 15), 16, 10).cast("bigint")
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    waiting = materialize(df.select(F.col(pid).alias("__pid"), "bucket", *numbers, key.alias("__tie")), "waiting")
    left = waiting.count()
    short = waiting.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(
        seats.groupBy("bucket").agg(F.sum("room").alias("room")), "bucket", "left"
    )
    if not short.where(F.coalesce("room", F.lit(0)) < F.col("n")).isEmpty():
        raise ValueError("the capacities do not cover the rows")
    many, rounds = left, 0
    contests: list[DataFrame] = []
    matched: list[DataFrame] = []
    sizes = [t.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")) for t in (waiting, seats)]
    large = reduce(DataFrame.unionByName, sizes).where(F.col("n") > local_rows).select("bucket").distinct()
    large = [r.bucket for r in large.collect()] if len(columns) <= MAX_DIMENSIONS else None
    if left and large is not None:
        own = F.col("bucket").isin(large) if large else F.lit(False)
        done = materialize(_match_in_tasks(waiting.where(~own), columns, seats.where(~own)), "matched")
        none, rounds = done.agg(F.count_if(F.col("ec").isNull()), F.max("__rounds")).first()
        if none:
            raise ValueError("a row has no distance to any class")
        matched, rounds = [done.select("__pid", "ec", "__d")], rounds or 0
        left = 0
        if large:
            rest, whole = waiting.where(own), waiting
            waiting, left = materialize(rest, "waiting"), rest.count()
            discard(whole)
    in_tasks, rounds = rounds, 0
    held_columns = ["__pid", "bucket", *columns, "__tie", "ec", "__d"]

    def holders(only: DataFrame | None = None) -> DataFrame:
        """The rows that classes hold: those kept in the last round that touched the class."""
        now = seats.select("ec", "bucket", "__round")
        if only is not None:
            now = now.join(small_side(only, spots), ["ec", "bucket"], "left_semi")
        now = small_side(now, spots)
        kept = [c.where("__won").join(now, ["ec", "bucket", "__round"]).select(*held_columns) for c in contests]
        return reduce(DataFrame.unionByName, kept)

    while left:
        rounds += 1
        proposed = nearest_center(
            waiting, columns, seats, "ec", group="bucket", name="ec", distance="__d",
            limit=("__most", "__last"), tie="__tie",
        )
        proposed = materialize(proposed.select(*held_columns), "proposed")
        if not proposed.where("ec IS NULL").isEmpty():
            raise ValueError("a row has no distance to any class")
        touched = proposed.select("ec", "bucket").distinct()
        rivals = proposed if not contests else proposed.unionByName(holders(touched))
        rivals = rivals.withColumn("__hex", F.lpad(F.lower(F.hex("__tie")), 16, "0"))
        ranked = rank_within(rivals, ["ec", "bucket"], "__d", "__hex", many, "__rn", cell_rows)
        open_ = seats.select("ec", "bucket", "room")
        decided = ranked.join(small_side(open_, spots), ["ec", "bucket"]).withColumn("__won", F.col("__rn") <= F.col("room"))
        decided = decided.withColumn("__round", F.lit(rounds)).drop("__rn", "__hex", "room")
        contests.append(materialize(decided, "contest"))
        discard(proposed)
        discard(waiting)
        ends = contests[-1].where("__won").groupBy("ec", "bucket").agg(
            F.count(F.lit(1)).alias("__n"), F.max(F.struct("__d", "__tie")).alias("__end")
        )
        full = F.col("__n") >= F.col("room")
        after = seats.join(ends, ["ec", "bucket"], "left").select(
            "ec", "bucket", "room", *columns,
            F.when(full, F.col("__end.__d")).otherwise(F.col("__most")).alias("__most"),
            F.when(full, F.col("__end.__tie")).otherwise(F.col("__last")).alias("__last"),
            F.when(F.col("__n").isNotNull(), F.lit(rounds)).otherwise(F.col("__round")).alias("__round"),
        )
        before, seats = seats, materialize(after, "seats")
        discard(before)
        waiting = materialize(contests[-1].where("NOT __won").select("__pid", "bucket", *columns, "__tie"), "waiting")
        left = waiting.count()
        if len(contests) > OPEN_CONTESTS:
            last = seats.select("ec", "bucket", "__round")
            whole = holders().join(small_side(last, spots), ["ec", "bucket"]).withColumn("__won", F.lit(True))
            whole = materialize(whole, "holders")
            for old in contests:
                discard(old)
            contests = [whole]
    if contests:
        matched.append(holders().select("__pid", "ec", "__d"))
    if not matched:
        placed = df.select("*", F.lit(None).cast("bigint").alias("ec"), F.lit(None).cast("double").alias("distance"))
        return Matching(placed, 0)
    found = reduce(DataFrame.unionByName, matched)
    found = found.select(F.col("__pid").alias(pid), "ec", F.col("__d").alias("distance"))
    return Matching(df.drop("ec", "distance").join(found, pid), max(rounds, in_tasks))


def _weighted_spread(cost_to, weights: np.ndarray, k: int, seed: int) -> list[int]:
    """Places of k candidates by k-means++: the j-th is the first whose prefix sum of
    weight times cost passes the j-th drawn share of the whole."""
    taken: list[int] = []
    cost = np.ones(len(weights))
    for j in range(k):
        drawn = int(hashlib.md5(f"pick/{seed}/{j}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        upto = np.cumsum(weights * cost)
        if upto[-1] > 0:
            at = min(int(np.searchsorted(upto, drawn * upto[-1], "right")), len(upto) - 1)
        else:  # only copies of the taken ones are left
            at = next(i for i in range(len(upto)) if i not in taken)
        taken.append(at)
        cost = np.minimum(cost, cost_to(at)) if j else cost_to(at)
    return taken


def seed_centers_mixed(
    df: DataFrame,
    columns: Sequence[str],
    categories: Sequence[tuple[str, int]],
    paths: DataFrame,
    pid: str,
    k: int,
    steps: int = 5,
    seed: int = 123456789,
) -> DataFrame:
    """Seed centres by squared numeric plus taxonomy distance (k-means||).

    ``columns`` are standardized; ``categories`` gives the height of every
    categorical column. From one row on, each step adds rows with probability
    2 k cost / (sum of costs), the cost being the distance to the nearest
    centre so far, drawn by the MD5 of the identifier. The candidates (about
    2 k steps) are weighed by the rows that are nearest to them and clustered
    again: k of them by weighted k-means++ in one task. Returned are these with
    their ``weight`` and their place ``pick``, from 0. Equal distances go to the
    earlier step, then to the smaller MD5.
    """
    from .taxonomy import with_ancestors

    columns = list(columns)
    rows, levels = with_ancestors(df, categories, paths)
    key = F.conv(F.substring(tie_key(F.col(pid)), 1, 15), 16, 10).cast("bigint")
    rows = rows.withColumn("__id", key).withColumns(
        {"__near": F.lit(None).cast("bigint"), "__cost": F.lit(float("inf"))}
    )
    kept = [c for c in rows.columns if c not in ("__near", "__cost")]
    fresh = materialize(rows.orderBy(draw(F.col(pid), seed), "__id").limit(1).select(kept), "seeds")
    chosen = [fresh]
    for step in range(1, steps + 2):
        seen = nearest_center(
            rows, columns, fresh, "__id", name="__new", distance="__far", mismatch=levels
        )
        closer = F.col("__far") < F.col("__cost")
        rows = materialize(
            seen.select(
                *kept,
                F.when(closer, F.col("__new")).otherwise(F.col("__near")).alias("__near"),
                F.least("__far", "__cost").alias("__cost"),
            ),
            "costs",
        )
        if step > steps:
            break
        total = rows.agg(F.sum("__cost")).first()[0]
        drawn = draw(F.col(pid), seed, step) * F.lit(total) < F.lit(2.0 * k) * F.col("__cost")
        fresh = materialize(rows.where(drawn).select(kept), "seeds")
        if fresh.isEmpty():
            break
        chosen.append(fresh)
    weights = rows.groupBy(F.col("__near").alias("__id")).agg(F.count(F.lit(1)).alias("weight"))
    candidates = materialize(reduce(DataFrame.unionByName, chosen).join(weights, "__id"), "candidates")
    found = candidates.count()
    if found < k:
        raise ValueError(f"{found} candidates for {k} centres; take more steps")
    shares, out = dict(levels), [pid, *columns, *[c for c, _ in categories], "weight"]

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(pid, ignore_index=True)
        numbers = [group[c].to_numpy(np.float64) for c in columns]
        levels_of = [(group[c].to_numpy(), w) for c, w in shares.items()]

        def cost_to(at: int) -> np.ndarray:
            far = np.zeros(len(group))
            for c in numbers:
                far += (c - c[at]) ** 2
            for c, weight in levels_of:
                far += weight * (c != c[at])
            return far

        taken = _weighted_spread(cost_to, group["weight"].to_numpy(np.float64), k, seed)
        return group.iloc[taken][out].assign(pick=np.arange(len(taken), dtype=np.int32))

    schema = candidates.select(*out, F.lit(0).alias("pick")).schema
    return candidates.groupBy().applyInPandas(pick, schema)
