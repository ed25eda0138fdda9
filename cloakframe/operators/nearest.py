"""Nearest centre of every row, by a pivot index over the centres.

About the square root of the number of centres stand as *pivots*; every centre
belongs to the cell of its nearest pivot, and a cell has a radius. By the triangle
inequality no centre of a cell is nearer to a row than the row's distance to the
pivot less the radius, so a row looks into its most promising cell first and then
only into cells that may still hold something nearer. Results are exact: bounds
are loosened by more than the rounding of a distance, and ties go to the smaller
number.

Centres that fit a broadcast are searched inside the tasks, without a shuffle. More
centres are cut into cells that each fit a task; rows and centres meet in groups by
cell, where rows of a hot cell are spread over several groups and a cell with very
many centres over several as well.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, materialize, small_side
from .boxtree import MAX_DIMENSIONS, build_tree, search_tree

#: Rows of a block, and distances (rows times centres) of a tile, in a task.
BLOCK, TILE = 2048, 1 << 21
#: Rows that meet the centres of a cell in one group.
GROUP_ROWS = 200_000
#: By how much (relatively) a bound is loosened against rounding.
SLACK = 1e-9
#: Broadcasts, one after the other, that centres in few dimensions may take.
MAX_SLABS = 4


def squares(rows: list[np.ndarray], centers: list[np.ndarray]) -> np.ndarray:
    """Squared distances of all rows to all centres, a coordinate after the other."""
    out = np.zeros((len(rows[0]), len(centers[0])))
    for mine, theirs in zip(rows, centers):
        out += (mine[:, None] - theirs[None, :]) ** 2
    return out


def build_index(
    ids: np.ndarray,
    numeric: list[np.ndarray],
    other: Sequence[np.ndarray] = (),
    limit: tuple[np.ndarray, np.ndarray] | None = None,
) -> dict:
    """Centres sorted by (cell, number), with pivots and radii.

    Centres with a coordinate that is not finite are no one's nearest. ``limit``
    gives (squared distance, tie) that a row must stay below for each centre.
    """
    use = np.flatnonzero(np.logical_and.reduce([np.isfinite(c) for c in numeric]))
    use = use[np.argsort(ids[use], kind="stable")]
    n = len(use)
    pick = np.arange(math.isqrt(n)) * n // max(1, math.isqrt(n))
    pivots = [c[use][pick] for c in numeric]
    cell, off = np.zeros(n, np.int64), np.zeros(n)
    step = max(1, TILE // max(1, len(pick)))
    for lo in range(0, n, step):
        far = squares([c[use[lo : lo + step]] for c in numeric], pivots)
        cell[lo : lo + step] = far.argmin(axis=1)
        off[lo : lo + step] = far.min(axis=1)
    order = np.argsort(cell, kind="stable")
    at = use[order]
    starts = np.searchsorted(cell[order], np.arange(len(pick) + 1))
    radius = np.zeros(len(pick))
    np.maximum.at(radius, cell, np.sqrt(off))
    most = np.full(len(pick), np.inf if limit is None else -np.inf)
    if limit is not None:
        np.maximum.at(most, cell[order], limit[0][at])
    return {
        "ids": ids[at],
        "numeric": [c[at] for c in numeric],
        "other": [c[at] for c in other],
        "limit": None if limit is None else (limit[0][at], limit[1][at]),
        "pivots": pivots,
        "radius": radius,
        "starts": starts,
        "most": most,
    }


def search(
    index: dict,
    numeric: list[np.ndarray],
    other: Sequence[np.ndarray] = (),
    weights: Sequence[float] = (),
    tie: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each row's nearest centre, and the distances
    to centres that were computed. Rows without one have an infinite distance."""
    count = len(numeric[0])
    ids, dist, work = np.zeros(count, np.int64), np.full(count, np.inf), 0
    if not len(index["ids"]):
        return ids, dist, work
    starts = index["starts"]

    def look(cell: int, at: np.ndarray) -> None:
        """Hold the rows ``at`` against the centres of a cell."""
        nonlocal work
        width = max(1, TILE // len(at))
        for first in range(starts[cell], starts[cell + 1], width):
            some = slice(first, min(first + width, starts[cell + 1]))
            far = squares([c[at] for c in numeric], [c[some] for c in index["numeric"]])
            for mine, theirs, weight in zip(other, index["other"], weights):
                far += weight * (mine[at][:, None] != theirs[None, some])
            work += far.size
            if index["limit"] is not None:
                most, last = (x[None, some] for x in index["limit"])
                far[~((far < most) | ((far == most) & (tie[at][:, None] < last)))] = np.inf
            low = far.argmin(axis=1)
            found, number = far[np.arange(len(at)), low], index["ids"][some][low]
            better = (found < dist[at]) | ((found == dist[at]) & (number < ids[at]) & (found < np.inf))
            ids[at[better]] = number[better]
            dist[at[better]] = found[better]

    for lo in range(0, count, BLOCK):
        block = np.arange(lo, min(lo + BLOCK, count))
        with np.errstate(invalid="ignore"):
            gap = np.sqrt(squares([c[block] for c in numeric], index["pivots"])) - index["radius"]
            least = np.maximum(gap - SLACK * (np.abs(gap) + 2 * index["radius"]), 0) ** 2 * (1 - SLACK)
        least[least > index["most"] * (1 + SLACK)] = np.inf
        first = least.argmin(axis=1)
        for cell in np.unique(first).tolist():
            look(cell, block[first == cell])
        for cell in range(len(starts) - 1):
            may = (least[:, cell] <= dist[block]) & (least[:, cell] < np.inf) & (first != cell)
            if may.any():
                look(cell, block[may])
    return ids, dist, work


def _split(series: Sequence[pd.Series], numeric: int, other: int, tie: bool):
    """Arrays of the coordinates, the other columns, and the tie."""
    arrays = [s.to_numpy() for s in series]
    coordinates = [a.astype(np.float64) for a in arrays[:numeric]]
    return coordinates, arrays[numeric : numeric + other], arrays[numeric + other] if tie else None


def _by_group(names: pd.Series) -> list[tuple[object, np.ndarray]]:
    values, codes = np.unique(names.to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(values) + 1))
    return [(g, order[a:b]) for g, a, b in zip(values.tolist(), ends, ends[1:])]


def _answer(ids: np.ndarray, dist: np.ndarray) -> pd.DataFrame:
    none = ~np.isfinite(dist)
    center = pd.array(ids, dtype="Int64")
    center[none] = pd.NA
    return pd.DataFrame({"center": center, "distance": np.where(none, np.nan, dist)})


def _search_groups(
    tables: dict, series, grouped: bool, numeric: int, weights: list[float], tie: bool,
    before: tuple[np.ndarray, np.ndarray] | None = None,
) -> pd.DataFrame:
    """The nearest centre of the rows in ``series``, each in its own group's index; or the
    (number, distance) that it had ``before``, if that is nearer."""
    own = series[:-1] if grouped else series
    rows, other, ties = _split(own, numeric, len(weights), tie)
    ids, dist = before or (np.zeros(len(series[0]), np.int64), np.full(len(series[0]), np.inf))
    for g, at in _by_group(series[-1]) if grouped else [(None, np.arange(len(ids)))]:
        if g in tables:
            mine = [c[at] for c in rows], [c[at] for c in other], weights, ties[at] if tie else None
            if "boxes" in tables[g]:
                found, far, _ = search_tree(tables[g], *mine, below=dist[at])
            else:
                found, far, _ = search(tables[g], *mine)
            better = (far < dist[at]) | ((far == dist[at]) & (found < ids[at]) & (far < np.inf))
            ids[at[better]], dist[at[better]] = found[better], far[better]
    return _answer(ids, dist)


def _indexes(chunk: pd.DataFrame, group: str | None, columns: list[str], other: list[str], limit: bool) -> dict:
    """The index of each group of a table of centres."""
    parts = chunk.groupby(group) if group else [(None, chunk)]
    build = build_tree if len(columns) <= MAX_DIMENSIONS else build_index
    return {
        g: build(
            t["__id"].to_numpy(np.int64),
            [t[c].to_numpy(np.float64) for c in columns],
            [t[c].to_numpy() for c in other],
            (t["__most"].to_numpy(np.float64), t["__last"].to_numpy(np.int64)) if limit else None,
        )
        for g, t in parts
        if len(t)
    }


def nearest_center(
    df: DataFrame,
    columns: Sequence[str],
    centers: DataFrame,
    center: str = "center",
    group: str | None = None,
    name: str = "center",
    distance: str = "distance",
    max_bytes: int = BROADCAST_BYTES,
    mismatch: Mapping[str, float] | None = None,
    limit: tuple[str, str] | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add the nearest centre of every row and its squared Euclidean distance.

    ``centers`` has the number ``center`` and ``columns``; with ``group`` a row
    sees only the centres of its own group. A column of ``mismatch`` adds its
    weight where row and centre differ. Ties go to the smaller number. With
    ``limit`` (two columns of ``centers``) a row sees only centres whose limit
    lies above its (distance, ``tie``). A row that sees none, or whose coordinates
    are null or not finite, gets null.

    Up to ``max_bytes`` of centres are broadcast; up to ``MAX_SLABS`` times as many in few
    dimensions come in slabs, one after the other; more meet the rows in cells.
    """
    columns, weights = list(columns), dict(mismatch or {})
    keys = [group] if group else []
    coordinates = [F.col(c).cast("double").alias(c) for c in columns] or [F.lit(0.0).alias("__zero")]
    columns = columns or ["__zero"]
    coordinates += [F.xxhash64(c).alias(c) for c in weights]
    cuts = [F.col(c).alias(n) for c, n in zip(limit or (), ("__most", "__last"))]
    wanted = centers.select(*keys, F.col(center).cast("bigint").alias("__id"), *coordinates, *cuts)
    fit = max(1, max_bytes // (8 * (len(coordinates) + 2 + len(cuts))))
    kept = [c for c in df.columns if c not in (name, distance)]
    asked = [*coordinates, *([F.col(tie)] if limit else []), *[F.col(g) for g in keys]]
    many = wanted.count()
    numbers = list(weights.values())
    slabs = [wanted] if many <= fit else _slabs(wanted, columns, many, fit)
    if slabs is None:
        return _nearest_in_cells(df.select(*kept), asked, columns, wanted, group, list(weights.items()), bool(limit), many, fit, name, distance)

    def best(slab: DataFrame, further: bool):
        tables = _indexes(slab.toPandas(), group, columns, list(weights), bool(limit))
        shared = df.sparkSession.sparkContext.broadcast(tables)

        @F.pandas_udf("center bigint, distance double")
        def nearest(*series: pd.Series) -> pd.DataFrame:
            before = None
            if further:
                before = series[0].fillna(0).to_numpy(np.int64, copy=True), series[1].fillna(np.inf).to_numpy(np.float64, copy=True)
                series = series[2:]
            return _search_groups(shared.value, series, bool(keys), len(columns), numbers, bool(limit), before)

        return nearest

    found = df.select(*kept, best(slabs[0], False)(*asked).alias("__found"))
    for slab in slabs[1:]:
        ask = best(slab, True)(F.col("__found.center"), F.col("__found.distance"), *asked)
        found = found.select(*kept, ask.alias("__found"))
    return found.select(*kept, F.col("__found.center").alias(name), F.col("__found.distance").alias(distance))


def _slabs(wanted: DataFrame, columns: list[str], many: int, fit: int) -> list[DataFrame] | None:
    """Centres cut across the first coordinate into tables that each fit a broadcast; None
    where these would be too many, or the coordinates too many for a tree."""
    count = math.ceil(1.1 * many / fit)
    if len(columns) > MAX_DIMENSIONS or count > MAX_SLABS:
        return None
    spot = F.col(columns[0])
    cuts = wanted.where(f"NOT isnan(`{columns[0]}`)").approxQuantile(columns[0], [i / count for i in range(1, count)], 0.01)
    slab = F.coalesce(reduce(Column.__add__, [(spot >= c).cast("int") for c in cuts]), F.lit(0))
    parts = [wanted.where(slab == i) for i in range(count)]
    if any(p.count() > fit for p in parts):
        return None
    return parts


def _cells_of(pivots: pd.DataFrame, columns: list[str]):
    """Column functions: a row's nearest pivot, and the other cells that may hold a
    nearer centre than its best so far. ``pivots`` has cell, radius and ``columns``."""
    numbers, radius = pivots["cell"].to_numpy(np.int64), pivots["radius"].to_numpy(np.float64)
    table = [pivots[c].to_numpy(np.float64) for c in columns]

    @F.pandas_udf("bigint")
    def first(*series: pd.Series) -> pd.Series:
        rows = [s.to_numpy(np.float64) for s in series]
        out = np.zeros(len(series[0]), np.int64)
        for lo in range(0, len(out), BLOCK):
            far = squares([r[lo : lo + BLOCK] for r in rows], table)
            out[lo : lo + BLOCK] = numbers[far.argmin(axis=1)]
        return pd.Series(out)

    @F.pandas_udf("array<bigint>")
    def others(own: pd.Series, best: pd.Series, *series: pd.Series) -> pd.Series:
        rows = [s.to_numpy(np.float64) for s in series]
        top, mine = best.fillna(np.inf).to_numpy(np.float64), own.to_numpy()
        out: list[np.ndarray] = []
        for lo in range(0, len(mine), BLOCK):
            gap = np.sqrt(squares([r[lo : lo + BLOCK] for r in rows], table)) - radius
            least = np.maximum(gap - SLACK * (np.abs(gap) + 2 * radius), 0) ** 2 * (1 - SLACK)
            may = (least <= top[lo : lo + BLOCK, None]) & (numbers[None, :] != mine[lo : lo + BLOCK, None])
            out += [numbers[m] for m in may]
        return pd.Series(out)

    return first, others


def _nearest_in_cells(
    df: DataFrame,
    asked: list[Column],
    columns: list[str],
    wanted: DataFrame,
    group: str | None,
    weights: list[tuple[str, float]],
    limit: bool,
    many: int,
    fit: int,
    name: str,
    distance: str,
) -> DataFrame:
    """:func:`nearest_center` where the centres do not fit a broadcast."""
    size = max(1, fit // 4)
    usable = wanted.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) < double('inf')" for c in columns))
    # At most ``fit`` pivots; beyond fit * size centres the cells grow.
    pivots = materialize(
        usable.orderBy(F.xxhash64("__id"), "__id").limit(min(fit, math.ceil(many / size))).select("__id", *columns)
        .dropDuplicates(columns), "pivots",
    )
    cells = nearest_center(usable, columns, pivots, "__id", name="__cell", distance="__off", max_bytes=1 << 62)
    cells = materialize(cells, "cells")
    per_cell = cells.groupBy("__cell").agg(F.sqrt(F.max("__off")).alias("radius"), F.count(F.lit(1)).alias("__n"))
    spots = per_cell.join(pivots.withColumnRenamed("__id", "__cell"), "__cell").toPandas()
    spots = spots.rename(columns={"__cell": "cell"})
    first, others = _cells_of(spots, columns)

    names = [*columns, *[c for c, _ in weights], *(["__tie"] if limit else []), *(["__group"] if group else [])]
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    table = materialize(numbered.withColumn("__asked", F.struct(*[a.alias(n) for a, n in zip(asked, names)])), "asked")
    narrow = table.select("__row", "__asked.*")
    finite = narrow.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) < double('inf')" for c in columns))
    chunks = F.ceil(F.col("__n") / F.lit(size)).cast("int")
    spread = cells.drop("__off").join(small_side(per_cell.select("__cell", "__n"), len(spots)), "__cell")
    spread = spread.withColumn("__chunk", F.pmod(F.xxhash64("__id"), chunks).cast("int"))
    numeric, numbers, grouped = len(columns), [w for _, w in weights], group is not None
    schema = "__row bigint, center bigint, distance double"

    def meet(rows: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        tables = _indexes(centers, group, columns, [c for c, _ in weights], limit) if len(centers) else {}
        found = _search_groups(tables, [rows[n] for n in names], grouped, numeric, numbers, limit)
        found.insert(0, "__row", rows["__row"].to_numpy())
        return found

    def in_cells(rows: DataFrame) -> DataFrame:
        """The best centre for each (row, cell) that is asked."""
        counts = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__rows"))
        counts = counts.withColumn("__salts", F.ceil(F.col("__rows") / F.lit(GROUP_ROWS)).cast("int"))
        per = materialize(counts.join(per_cell.select("__cell", chunks.alias("__chunks")), "__cell"), "cell-rows")
        per = small_side(per.select("__cell", "__salts", "__chunks"), len(spots))
        left = rows.join(per, "__cell").withColumn("__salt", F.pmod(F.xxhash64("__row"), F.col("__salts")).cast("int"))
        left = left.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
        right = spread.join(per, "__cell").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
        keys = ["__cell", "__salt", "__chunk"]
        left, right = left.select(*keys, "__row", *names), right.drop("__salts", "__chunks", "__n")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)

    began = materialize(finite.withColumn("__cell", first(*[F.col(c) for c in columns])), "first-cells")
    best = F.min(F.struct("distance", "center")).alias("best")
    near = F.col("center").isNotNull()
    here = in_cells(began).where(near).groupBy("__row").agg(best)
    here = materialize(here.select("__row", "best.center", "best.distance"), "first-best")
    more = began.join(here, "__row", "left").withColumn(
        "__cell", F.explode(others("__cell", "distance", *[F.col(c) for c in columns]))
    )
    there = in_cells(materialize(more.drop("center", "distance"), "more-cells")).where(near)
    both = here.select("__row", "distance", "center").unionByName(there.select("__row", "distance", "center"))
    found = both.groupBy("__row").agg(best)
    joined = table.drop("__asked").join(found, "__row", "left")
    kept = [c for c in df.columns]
    return joined.select(*kept, F.col("best.center").alias(name), F.col("best.distance").alias(distance))
