"""Class centres, nearest centres and assignment against plain re-derivations."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import centers, nearest


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def clustered(rng, count, cells=40, width=0.02):
    middles = [(rng.random() * 10, rng.random() * 10) for _ in range(cells)]
    return np.array([[rng.gauss(m, width) for m in middles[rng.randrange(cells)]] for _ in range(count)])


def test_index_is_exact_and_skips_most_centres():
    rng = random.Random(1)
    table, rows = clustered(rng, 4000), clustered(rng, 3000)
    rows[:500] = table[:500]  # distance 0, and copies
    table[100:110] = table[0]
    ids = np.array(rng.sample(range(10**6), len(table)))
    index = nearest.build_index(ids, list(table.T))
    found, dist, work = nearest.search(index, list(rows.T))
    whole = nearest.squares(list(rows.T), list(table.T))
    least = whole.min(axis=1)
    want = np.where(whole == least[:, None], ids[None, :], 1 << 60).min(axis=1)
    assert (dist == least).all() and (found == want).all()
    assert work + len(rows) * len(index["radius"]) < 0.1 * whole.size


def test_index_passes_over_full_centres():
    rng = random.Random(2)
    table, rows = clustered(rng, 900), clustered(rng, 500)
    limit = np.where(np.arange(900) % 3 == 0, 0.0, np.where(np.arange(900) % 3 == 1, 0.01, np.inf))
    last = np.array([rng.randrange(100) for _ in range(900)])
    ties = np.array([rng.randrange(100) for _ in range(500)])
    rows[:50], limit[:50] = table[:50], 0.0  # equal to the limit: the tie decides
    index = nearest.build_index(np.arange(900), list(table.T), limit=(limit, last))
    found, dist, work = nearest.search(index, list(rows.T), tie=ties)
    whole = nearest.squares(list(rows.T), list(table.T))
    whole[~((whole < limit) | ((whole == limit) & (ties[:, None] < last)))] = np.inf
    assert (dist == whole.min(axis=1)).all()
    assert (found == whole.argmin(axis=1))[np.isfinite(dist)].all()
    assert work < whole.size / 4


@pytest.mark.parametrize("grouped", [False, True])
def test_nearest_in_cells(spark, monkeypatch, grouped):
    """Centres beyond a broadcast: hot cells, copies, gaps and groups."""
    monkeypatch.setattr(nearest, "GROUP_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, *p, i % 3, "ab"[i % 2]) for i, p in enumerate(clustered(rng, 300).tolist())]
    rows += [(300 + i, 1.0, 1.0, 1, "a") for i in range(120)] + [(500, None, 1.0, 1, "a"), (501, float("nan"), 0.0, 0, "b")]
    middle = [(i, *p, i % 3, "ab"[i % 2]) for i, p in enumerate(clustered(rng, 60).tolist())]
    middle += [(60 + i, 1.0, 1.0, 1, "b") for i in range(40)] + [(200, None, 0.0, 1, "a")]
    df = spark.createDataFrame(rows, "pid int, x double, y double, g int, c string")
    table = spark.createDataFrame(middle, "n int, x double, y double, g int, c string")
    got = nearest.nearest_center(
        df, ["x", "y"], table, "n", group="g" if grouped else None, max_bytes=400, mismatch={"c": 0.3}
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.x is None or math.isnan(r.x):
            assert r.center is None
            continue
        want = min(
            (far((r.x, r.y), m[1:3]) + 0.3 * (m[4] != r.c), m[0])
            for m in middle if m[1] is not None and (not grouped or m[3] == r.g)
        )
        assert r.distance == pytest.approx(want[0]) and r.center == want[1]


def greedy(rows, middle, room):
    """All pairs by (distance, tie of the row), the closest first."""
    ties = {r[0]: hashlib.md5(str(r[0]).encode()).hexdigest() for r in rows}
    left, out = dict(room), {}
    pairs = sorted((far(r[1:3], m[1:]), m[0], ties[r[0]], r[0], r[3]) for r in rows for m in middle)
    # Between pairs of equal distance: a row prefers the smaller class, a class the smaller tie.
    for _, ec, _, pid, bucket in pairs:
        if pid not in out and left.get((ec, bucket), 0):
            left[ec, bucket] -= 1
            out[pid] = ec
    return out


def case(rng, count=240, classes=12, grid=None):
    spot = (lambda: rng.randrange(grid)) if grid else rng.random
    rows = [(i, float(spot()), float(spot()), 1 + i % 2) for i in range(count)]
    middle = [(e, float(spot()), float(spot())) for e in range(classes)]
    room = {(e, b): 0 for e in range(classes) for b in (1, 2)}
    for _, _, _, b in rows + rows[: count // 10]:
        room[rng.randrange(classes), b] += 1
    return rows, middle, room


def frames(spark, rows, middle, room):
    return (
        spark.createDataFrame(rows, "pid int, x double, y double, bucket bigint"),
        spark.createDataFrame(middle, "ec bigint, x double, y double"),
        spark.createDataFrame([(e, b, n) for (e, b), n in room.items()], "ec bigint, bucket bigint, size bigint"),
    )


@pytest.mark.parametrize("cell_rows", [1_000_000, 30])
def test_matching_is_the_plain_greedy(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(centers, "OPEN_CONTESTS", 2)
    rows, middle, room = case(random.Random(4))
    df, table, seats = frames(spark, rows, middle, room)
    made = centers.match_to_centers(df, ["x", "y"], "pid", table, seats, cell_rows)
    assert {r.pid: r.ec for r in made.rows.collect()} == greedy(rows, middle, room)
    assert made.rows.columns == [*df.columns, "ec", "distance"] and made.rounds > 2


def test_matching_has_no_blocking_pair_with_ties(spark):
    """On a grid most distances are equal."""
    rows, middle, room = case(random.Random(5), 150, 6, grid=3)
    df, table, seats = frames(spark, rows, middle, room)
    got = {r.pid: r.ec for r in centers.match_to_centers(df, ["x", "y"], "pid", table, seats).rows.collect()}
    ties = {r[0]: hashlib.md5(str(r[0]).encode()).hexdigest() for r in rows}
    place = {m[0]: m[1:] for m in middle}
    held = {}
    for pid, x, y, bucket in rows:
        held.setdefault((got[pid], bucket), []).append((far((x, y), place[got[pid]]), ties[pid]))
    assert all(len(v) <= room[k] for k, v in held.items())
    for pid, x, y, bucket in rows:
        own = (far((x, y), place[got[pid]]), got[pid])
        for ec, spot in place.items():
            here = far((x, y), spot)
            if (here, ec) < own and room[ec, bucket]:
                others = held.get((ec, bucket), [])
                assert len(others) == room[ec, bucket] and max(others) < (here, ties[pid])


def test_rounds_follow_preferences_not_classes(spark):
    """Every class is full in the end, yet one round places all rows."""
    middle = [(e, float(e), 0.0) for e in range(60)]
    rows = [(i, i % 60 + 0.1, 0.0, 1) for i in range(240)]
    df, table, seats = frames(spark, rows, middle, {(e, 1): 4 for e in range(60)})
    assert centers.match_to_centers(df, ["x", "y"], "pid", table, seats).rounds == 1


def test_matching_errors_and_empty(spark):
    rows, middle, room = case(random.Random(6), 20, 3)
    df, table, seats = frames(spark, rows, middle, room)
    with pytest.raises(ValueError, match="capacities"):
        centers.match_to_centers(df, ["x", "y"], "pid", table, seats.where("ec = 1"))
    with pytest.raises(ValueError, match="distance"):
        bad = df.selectExpr("pid", "CASE WHEN pid > 3 THEN x END AS x", "y", "bucket")
        centers.match_to_centers(bad, ["x", "y"], "pid", table, seats)
    none = centers.match_to_centers(df.limit(0), ["x", "y"], "pid", table, seats)
    assert none.rows.collect() == [] and none.rounds == 0


def drawn(name, seed, step=0):
    return int(hashlib.md5(f"{name}/{seed}/{step}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def test_random_centres_are_one_plain_step(spark):
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "pid int, x double, y double")
    sizes = spark.createDataFrame([(100 + e, e % 4) for e in range(9)], "ec bigint, size bigint")
    made = centers.class_centers_random(df, ["x", "y"], sizes, seed=11, pid="pid").collect()
    seeds = [r[1:] for r in sorted(rows, key=lambda r: drawn(r[0], 11))[:9]]
    members = {}
    for r in rows:
        members.setdefault(min(range(9), key=lambda i: (far(r[1:], seeds[i]), i)), []).append(r[1:])
    order = sorted(range(9), key=lambda e: (-(e % 4), e))
    for i, e in enumerate(order):
        row = next(r for r in made if r.ec == 100 + e)
        mean = [sum(c) / len(c) for c in zip(*members[i])]
        assert row.cluster == i and [row.x, row.y] == pytest.approx(mean)


def test_kmeans_centres_are_means_of_their_members(spark):
    rng = random.Random(8)
    spots = [(3.0 * i, 5.0 * (i % 4)) for i in range(12)]
    rows = [(i, *(rng.gauss(c, 0.01) for c in spots[i % 12])) for i in range(480)]
    df = spark.createDataFrame(rows, "pid int, x double, y double")
    sizes = spark.createDataFrame([(e, 40) for e in range(12)], "ec bigint, size bigint")
    for groups in (1000, 3):
        made = centers.class_centers(df, ["x", "y"], sizes, "pid", group_clusters=groups).collect()
        assert sorted(r.cluster for r in made) == list(range(12))
        if groups == 1000:  # spread seeds find well separated clusters
            near = {min(range(12), key=lambda i: far((r.x, r.y), spots[i])) for r in made}
            assert len(near) >= 11
        members = {}
        for r in rows:
            members.setdefault(min(made, key=lambda c: far(r[1:], (c.x, c.y))).ec, []).append(r[1:])
        moved = [far((c.x, c.y), [sum(v) / len(v) for v in zip(*members[c.ec])]) for c in made if c.ec in members]
        assert sum(m < 1e-9 for m in moved) >= 6


def test_many_classes(spark):
    """100,000 centres in coarse cells; half of the rows lie in one spot."""
    rows = spark.range(300_000).selectExpr(
        "id AS pid", "IF(id % 2 = 0, rand(1) * 1e-3, rand(2) * 100) AS x", "IF(id % 2 = 0, rand(3) * 1e-3, rand(4) * 100) AS y"
    )
    sizes = spark.range(100_000).selectExpr("id AS ec", "3 AS size")
    made = centers.class_centers(rows, ["x", "y"], sizes, "pid", random=True, group_clusters=2000)
    row = made.selectExpr("count(*) AS n", "count(DISTINCT ec) AS ecs", "count(DISTINCT cluster) AS c", "count(DISTINCT x, y) AS p", "max(cluster) AS m", "sum(CASE WHEN x < 1e-3 THEN 1 ELSE 0 END) AS hot").first()
    assert (row.n, row.ecs, row.c, row.m) == (100_000, 100_000, 100_000, 99_999)
    assert row.p > 99_000 and 45_000 < row.hot < 55_000


def test_many_classes_need_no_model_on_the_driver(spark, monkeypatch):
    """1,500 classes: seeded in tables; the plain model seeds them on the driver."""

    def none(**_):
        raise AssertionError("a model of as many centres as classes")

    monkeypatch.setattr(centers, "KMeans", none)
    rows = spark.range(4500).selectExpr("id AS pid", "rand(5) * 100 AS x")
    sizes = spark.range(1500).selectExpr("id AS ec", "3 AS size")
    made = centers.class_centers_kmeans(rows, ["x"], sizes).collect()
    assert sorted(r.cluster for r in made) == list(range(1500)) == [r.cluster for r in sorted(made, key=lambda r: r.ec)]
    assert len({r.x for r in made}) > 1000
    for gap in ("null", "double('nan')"):
        with pytest.raises(ValueError, match="null or NaN"):
            centers.class_centers_kmeans(rows.withColumn("x", F.expr(f"IF(pid = 7, {gap}, x)")), ["x"], sizes)


def plain_rounds(rows, middle, room):
    """{pid: ec}: all waiting rows ask the nearest class with room; the closest get it."""
    room, out, waiting = dict(room), {}, list(rows)
    while waiting:
        asked = {}
        for pid, x, bucket in waiting:
            d, ec = min(((x - c) ** 2, ec) for ec, c in middle if room.get((ec, bucket)))
            asked.setdefault((ec, bucket), []).append((d, hashlib.md5(str(pid).encode()).hexdigest(), (pid, x, bucket)))
        waiting = []
        for (ec, bucket), those in asked.items():
            for i, (_, _, row) in enumerate(sorted(those)):
                if i < room[ec, bucket]:
                    out[row[0]] = ec
                else:
                    waiting.append(row)
            room[ec, bucket] -= min(len(those), room[ec, bucket])
    return out


def test_last_rounds_of_an_assignment_are_no_jobs(spark, monkeypatch):
    """Rows crowd at one end of a line of classes, so that a round fills one of them."""
    rng = random.Random(17)
    rows = [(i, rng.choice([0.0, 0.1, rng.random()]), i % 2) for i in range(120)]
    middle = [(e, float(e)) for e in range(20)]
    room = {(e, b): 3 + (e == 4) for e in range(20) for b in (0, 1)}
    df = spark.createDataFrame(rows, "pid int, x double, bucket int")
    table = spark.createDataFrame(middle, "ec int, x double")
    seats = spark.createDataFrame([(*k, n) for k, n in room.items()], "ec int, bucket int, size int")
    own, rounds = centers.nearest_center, []
    monkeypatch.setattr(centers, "nearest_center", lambda *a, **k: rounds.append(1) or own(*a, **k))
    want = plain_rounds(rows, middle, room)
    for local, most in ((100, 0), (40, 12)):  # at once; after the rounds that leave 40 rows
        rounds.clear()
        out = centers.redistribute_by_center(df, ["x"], "pid", table, seats, local_rows=local)
        assert out.columns == ["pid", "x", "bucket", "ec"]
        assert {r.pid: r.ec for r in out.collect()} == want
        assert len(rounds) <= most


def test_copies_and_gaps_in_class_centres(spark):
    rows = [(i, float(i % 3)) for i in range(60)] + [(60, None), (61, float("nan"))]
    df = spark.createDataFrame(rows, "pid int, x double")
    sizes = spark.createDataFrame([(e, 10 + e) for e in range(5)], "ec bigint, size bigint")
    for random_ in (True, False):
        made = {r.ec: (r.cluster, r.x) for r in centers.class_centers(df, ["x"], sizes, "pid", random=random_).collect()}
        assert {e: c for e, (c, _) in made.items()} == {e: 4 - e for e in range(5)}
        assert all(x is not None for _, x in made.values())
    assert centers.class_centers(df.limit(0), ["x"], sizes, "pid").where("x IS NULL").count() == 5
    assert centers.class_centers(df, ["x"], sizes.limit(0), "pid").collect() == []
