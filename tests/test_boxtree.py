"""The tree of boxes against all pairs, and what is built on it."""

from __future__ import annotations

import time

import numpy as np
import pytest

from cloakframe.operators import boxtree, centers, nearest


def spots(rng, grid, dimensions, count):
    if not grid:
        return list(rng.normal(size=(dimensions, count)))
    return list(rng.integers(0, grid, (dimensions, count)) * 0.5)


@pytest.mark.parametrize("dimensions, count, grid", [(1, 2000, 40), (2, 3000, None), (3, 3000, 12), (6, 900, None), (2, 5, None), (1, 1, None)])
def test_tree_is_exact(dimensions, count, grid):
    """Ties, copies, limits, and what comes after a centre in a row's order."""
    rng = np.random.default_rng(1)
    table, rows = spots(rng, grid, dimensions, count), spots(rng, grid, dimensions, 400)
    ids, ties = rng.permutation(10 * count)[:count], rng.integers(0, 100, 400)
    limit = rng.choice([0.0, 0.01, 0.5, np.inf], count), rng.integers(0, 100, count)
    for cut in (None, limit):
        whole = nearest.squares(rows, table)
        if cut:
            whole[~((whole < cut[0]) | ((whole == cut[0]) & (ties[:, None] < cut[1])))] = np.inf
        tree = boxtree.build_tree(ids, table, limit=cut)
        least = whole.min(axis=1)
        found, dist, _ = boxtree.search_tree(tree, rows, tie=ties)
        want = np.where(whole == least[:, None], ids, 10 * count).min(axis=1)
        assert (dist == least).all() and (found == want)[np.isfinite(least)].all()
        if cut:
            behind = (whole > least[:, None]) | ((whole == least[:, None]) & (ids > want[:, None]))
            second = np.where(behind, whole, np.inf)
            some = np.isfinite(least)
            found, dist, _ = boxtree.search_tree(
                tree, [c[some] for c in rows], tie=ties[some], after=(least[some], want[some])
            )
            least, second = second[some].min(axis=1), second[some]
            want = np.where(second == least[:, None], ids, 10 * count).min(axis=1)
            assert (dist == least).all() and (found == want)[np.isfinite(least)].all()


def test_limits_may_change_one_by_one():
    rng = np.random.default_rng(2)
    table, rows, ties = spots(rng, None, 2, 700), spots(rng, None, 2, 100), rng.integers(0, 9, 100)
    most, last = np.full(700, np.inf), np.zeros(700, np.int64)
    tree = boxtree.build_tree(np.arange(700), table, limit=(most, last))
    whole = nearest.squares(rows, table)
    for _ in range(6):
        only = rng.permutation(700)[:200]
        most[only], last[only] = rng.random(200) * 0.1, rng.integers(0, 9, 200)
        boxtree.set_limit(tree, most, last, only)
        far = np.where((whole < most) | ((whole == most) & (ties[:, None] < last)), whole, np.inf)
        assert (boxtree.search_tree(tree, rows, tie=ties)[1] == far.min(axis=1)).all()


def test_cost_of_a_row_grows_with_the_depth():
    rng = np.random.default_rng(3)
    rows, work = spots(rng, None, 3, 500), []
    for count in (2_000, 128_000):
        tree = boxtree.build_tree(np.arange(count), spots(rng, None, 3, count))
        work.append(boxtree.search_tree(tree, rows)[2] / 500)
    assert work[1] < 3 * work[0] < 1000  # 64 times as many centres; a pivot index takes 8 times


def test_rows_and_centres_without_a_number():
    gap = [np.array([np.nan, 0.0, np.inf, 1.0]), np.array([0.0, np.nan, 0.0, 1.0])]
    found, dist, _ = boxtree.search_tree(boxtree.build_tree(np.arange(4), gap), gap)
    assert list(found) == [0, 0, 0, 3] and list(np.isinf(dist)) == [True, True, True, False]
    assert np.isinf(boxtree.search_tree(boxtree.build_tree(np.arange(3), [c[:3] for c in gap]), gap)[1]).all()


@pytest.mark.parametrize("grouped", [False, True])
def test_centres_in_slabs(spark, monkeypatch, grouped):
    """Some more centres than a broadcast holds: no cells, and each row is nearest to the same."""

    def none(*_):
        raise AssertionError("rows and centres meet in cells")

    monkeypatch.setattr(nearest, "_nearest_in_cells", none)
    rng = np.random.default_rng(4)
    rows = [(i, *p, i % 3) for i, p in enumerate((rng.integers(0, 9, (300, 2)) / 2).tolist())] + [(300, None, 1.0, 1)]
    middle = [(i, *p, i % 3) for i, p in enumerate((rng.integers(0, 18, (90, 2)) / 4).tolist())] + [(90, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "pid int, x double, y double, g int")
    table = spark.createDataFrame(middle, "n int, x double, y double, g int")
    got = nearest.nearest_center(df, ["x", "y"], table, "n", group="g" if grouped else None, max_bytes=32 * 40)
    for r in got.collect():
        if r.x is None:
            assert r.center is None and r.distance is None
            continue
        want = min(((r.x - m[1]) ** 2 + (r.y - m[2]) ** 2, m[0]) for m in middle if m[1] is not None and (not grouped or m[3] == r.g))
        assert (r.distance, r.center) == want
    assert got.count() == len(rows)


def test_seeds_among_copies():
    """Once only copies are left, the rest of the seeds are the rows in their order."""
    points = np.repeat(np.arange(3.0), 4000)[:, None]
    began = time.process_time()
    taken = centers._spread_seeds(points, 4000, np.random.default_rng(5))
    assert time.process_time() - began < 5  # was minutes
    assert len(set(taken.tolist())) == 4000 and sorted(points[taken[:3], 0]) == [0.0, 1.0, 2.0]
    assert taken[3:].tolist() == [i for i in range(4000) if i not in taken[:3]][:3997]
