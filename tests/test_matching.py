"""Matching in tasks against the rounds that are jobs, and against a plain matching."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cloakframe.operators import centers


def plain(rows, middle, room):
    """{pid: ec}: a row after the other asks its classes in order; a class keeps the closest."""
    tie = {r[0]: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16) for r in rows}
    order, held, out = {}, {}, {}
    for pid, x, y, bucket in rows:
        order[pid] = iter(sorted(((x - m[1]) ** 2 + (y - m[2]) ** 2, m[0]) for m in middle if room.get((m[0], bucket))))
        asks = [(pid, bucket)]
        while asks:
            who, b = asks.pop()
            d, ec = next(order[who])
            seats = held.setdefault((ec, b), [])
            seats.append((d, tie[who], who))
            seats.sort()
            out[who] = ec
            if len(seats) > room[ec, b]:
                asks.append((seats.pop()[2], b))
    return out


def case(seed, grid):
    rng = random.Random(seed)
    spot = (lambda: rng.randrange(grid) * 0.3) if grid else rng.random
    rows = [(i, spot(), spot(), 1 + i % 3) for i in range(210)]
    middle = [(e, spot(), spot()) for e in range(14)]
    room = {(e, b): 0 for e in range(14) for b in (1, 2, 3)}
    for _, _, _, b in rows:
        room[rng.randrange(14), b] += 1
    return rows, middle, room


def frames(spark, rows, middle, room):
    return (
        spark.createDataFrame(rows, "pid int, x double, y double, bucket bigint"),
        spark.createDataFrame(middle, "ec bigint, x double, y double"),
        spark.createDataFrame([(e, b, n) for (e, b), n in room.items()], "ec bigint, bucket bigint, size bigint"),
    )


@pytest.mark.parametrize("grid", [None, 3])
def test_tasks_and_jobs_match_alike(spark, monkeypatch, grid):
    rows, middle, room = case(9, grid)
    rows = rows[:-9]  # the buckets have 67 rows
    rows += [(1000 + i, *rows[0][1:3], 4) for i in range(30)]  # copies of one, in a small bucket
    room |= {(e, 4): 1 + e for e in range(14)}
    df, table, seats = frames(spark, rows, middle, room)
    want = plain(rows, middle, room)
    own, rounds = centers.nearest_center, []
    monkeypatch.setattr(centers, "nearest_center", lambda *a, **k: rounds.append(1) or own(*a, **k))
    for local, jobs in ((100, False), (40, True), (0, True)):  # all in tasks; one bucket; none
        rounds.clear()
        made = centers.match_to_centers(df, ["x", "y"], "pid", table, seats, local_rows=local)
        got = {r.pid: (r.ec, r.distance) for r in made.rows.collect()}
        assert {p: e for p, (e, _) in got.items()} == want and bool(rounds) == jobs and made.rounds > 1
        place = {m[0]: m[1:] for m in middle}
        assert all(got[p][1] == pytest.approx((x - place[want[p]][0]) ** 2 + (y - place[want[p]][1]) ** 2) for p, x, y, _ in rows)


def test_equal_rows_ask_several_classes_in_a_round():
    """2,000 copies of a row and as many classes: not a round for each."""
    rng = np.random.default_rng(10)
    spots, ties = rng.random(2000), rng.permutation(2000)
    found, far, rounds = centers._match([np.full(2000, 0.5)], ties, np.arange(2000), [spots], np.ones(2000, np.int64))
    assert rounds < 2000 / 30
    order = np.lexsort((np.arange(2000), (spots - 0.5) ** 2))
    assert (found[np.argsort(ties)] == order).all() and (far == (0.5 - spots[found]) ** 2).all()


def test_identifiers_that_repeat_or_are_null(spark):
    rows = [(1, 0.0, 1), (1, 0.0, 1), (None, 0.1, 1), (2, 5.0, 1)]
    df = spark.createDataFrame(rows, "pid int, x double, bucket bigint")
    table = spark.createDataFrame([(1, 0.0), (2, 5.0)], "ec bigint, x double")
    seats = spark.createDataFrame([(1, 1, 3), (2, 1, 1)], "ec bigint, bucket bigint, size bigint")
    got = centers.match_to_centers(df, ["x"], "pid", table, seats).rows
    assert sorted((r.pid, r.ec) for r in got.collect()) == [(1, 1)] * 4 + [(2, 2)]  # a join on the identifier
