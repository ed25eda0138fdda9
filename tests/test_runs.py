"""Buckets by runs of equal counts, split rules by least totals, methods of callers."""

from __future__ import annotations

import random
import sys
import time

import numpy as np
import plain
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_plans import as_buckets, histogram, leaves_of

import cloakframe as cf
from cloakframe.operators import bucketing, classes
from cloakframe.operators.ranking import rank_sorted
from cloakframe.runtime import materialize

# Rules of a caller run in tasks, where this file cannot be imported.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("groups", [["g"], []])
def test_rank_sorted(spark, groups):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["same", "x", None, str(rng.random())])) for i in range(700)]
    df = spark.createDataFrame(rows, "pid int, g int, k string")
    plainly = {r.pid: r.rn for r in rank_sorted(df, groups, ["k", "pid"], 700).collect()}
    ranges = {r.pid: r.rn for r in rank_sorted(df, groups, ["k", "pid"], 700, cell_rows=60).collect()}
    assert ranges == plainly and len(ranges) == 700


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_the_plain_fold(spark, seed):
    """Many values with few counts, ranked and numbered in ranges."""
    rng = random.Random(seed)
    hist = {f"v{i:04d}": rng.choice([1, 1, 1, 2, 2, 3, 7, 7, 20, 21]) for i in range(400)}
    hist["hot"] = sum(hist.values()) // 2
    limits = [0.2, 1.0, 2.0, 3.0]
    plan = materialize(bucketing.beta_buckets(histogram(spark, hist), limits, cell_rows=50), "t")
    found = as_buckets(plan)
    for beta in limits:
        got = [(sorted(c), f, k) for (t, _), (c, f, k) in found.items() if t == beta]
        want = plain.beta_buckets(hist, beta)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
        assert [b for t, b in found if t == beta] == list(range(1, len(want) + 1))


def test_a_million_values(spark):
    """The fold walks the counts, not the values; same buckets as a walk over them."""
    rng = np.random.default_rng(3)
    counts = np.minimum(rng.zipf(1.6, 1_000_000), 5000)
    total = int(counts.sum())
    frame = spark.createDataFrame([(int(c), int(n)) for c, n in zip(*np.unique(counts, return_counts=True))], "freq bigint, n bigint")
    spread = frame.select("freq", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    hist = spread.select(
        F.concat_ws("-", F.lpad(F.col("freq").cast("string"), 6, "0"), F.lpad(F.col("i").cast("string"), 8, "0")).alias("sa"),
        "freq", F.lit(total).alias("total"), (F.col("freq") / F.lit(total)).alias("p"),
    )
    plan = bucketing.beta_buckets(hist, [1.5], cell_rows=200_000)
    made = plan.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("freq").alias("freq"), F.sum("quota").alias("q"))
    got = made.groupBy("n", "freq", "q").count().collect()
    want, share, room, held, size = {}, 0.0, float("inf"), 0, 0
    for c in np.sort(counts).tolist():
        p = c / total
        cap = (1 + min(1.5, -np.log(p))) * p
        if share + p > min(room, cap):
            want[held, size] = want.get((held, size), 0) + 1
            share, room, held, size = 0.0, float("inf"), 0, 0
        share, room, held, size = share + p, min(room, cap), held + 1, size + c
    want[held, size] = want.get((held, size), 0) + 1
    assert all(r.freq == r.q for r in got)
    assert {(r.n, r.freq): r["count"] for r in got} == want


@pytest.mark.parametrize("seed", range(6))
def test_least_totals_decide_as_sizes_do(seed):
    rng = np.random.default_rng(seed)
    freq = rng.integers(0, rng.choice([5, 60, 5000]), rng.integers(1, 40))
    freq[0] += 1
    cap = np.round(rng.random(len(freq)) * rng.choice([0.2, 0.6, 1.5]), rng.integers(1, 4))
    fits = classes.likeness_fits(freq, cap, 1.0)
    bound = np.floor(cap * 100.0 + 0.5)
    for level in range(1, 12):
        for path in {0, 1, (1 << level) - 1, *rng.integers(0, 1 << level, 20).tolist()}:
            sizes = (freq + path) >> level
            total = float(sizes.sum())
            want = total > 0 and bool((np.floor(sizes / max(total, 1) * 100.0 + 0.5) <= bound).all())
            assert fits(int(path), level) == want


def test_twenty_thousand_buckets(spark):
    rng = np.random.default_rng(9)
    freq = rng.integers(1, 2_000_000, 20_000)
    rows = [(1.0, i + 1, int(f), 0.001) for i, f in enumerate(freq.tolist())]
    sizes = spark.createDataFrame(rows, "threshold double, bucket bigint, freq bigint, cap double")
    began = time.monotonic()
    states = materialize(classes.class_states(sizes, "likeness"), "t")
    assert states.where("NOT splits").agg(F.sum("nodes")).first()[0] > 100
    assert time.monotonic() - began < 300


def at_least_half(freq, cap, threshold):
    """A rule of a caller: no bucket is more than ``threshold`` times its share off."""
    share = freq / freq.sum()

    def holds(sizes):
        return bool((np.abs(sizes / sizes.sum() - share) <= threshold * share).all())

    return holds


def test_rule_of_a_caller(spark):
    hist = {"a": 64, "b": 100, "c": 37}
    plan = materialize(bucketing.beta_buckets(histogram(spark, hist), [0.3]), "t")
    buckets = [f for _, (_, f, _) in as_buckets(plan).items()]
    holds = at_least_half(np.array(buckets), None, 0.3)
    want = plain.classes(buckets, lambda s: holds(np.array(s)))
    states = materialize(classes.class_states(plan, at_least_half), "t")
    got = {k: tuple(v.values()) for k, v in leaves_of(plan, states)[0.3].items()}
    assert got == want and len(want) > 4


def single_values(histogram, limits, paths, height):
    """Every value is a bucket of its own."""
    listed = F.explode(F.array(*[F.lit(float(v)) for v in limits]))
    rows = histogram.select(listed.alias("threshold"), "sa", "freq", "p")
    items = F.array(F.struct("sa", F.col("freq").alias("n")))
    buckets = rows.select("threshold", items.alias("items"), "freq", F.col("p").alias("cap"))
    return bucketing.explode_buckets(bucketing.number_buckets(buckets))


def test_method_of_a_caller(spark, monkeypatch):
    rows = [(i, float(i % 10), "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "pid int, x double, sa string")
    roles = cf.Roles("pid", ["x"], "sa")
    own = cf.Method(single_values, at_least_half)
    monkeypatch.setitem(cf.METHODS, "single", own)
    for method in (own, "single"):
        out = cf.anonymize(df, roles, method, 0.25, keep_pid=True)
        shares = out.groupBy("x").pivot("sa").count().collect()
        assert out.count() == 120 and len(shares) > 5
        assert all(abs(r[c] / (r.a + r.b + r.c) - 1 / 3) <= 0.25 / 3 for r in shares for c in "abc")
    swept = cf.threshold_sweep(df, "sa", "single", 0.0, 1.0, 0.5).collect()
    assert sorted((r.threshold, r.buckets) for r in swept) == [(0.5, 3), (1.0, 3)]
    lossy = cf.Method(lambda h, *rest: single_values(h.where("sa <> 'a'"), *rest))
    with pytest.raises(ValueError, match="add up"):
        cf.class_plan(df, "sa", lossy, 1.0)
    with pytest.raises(ValueError, match="lacks"):
        cf.class_plan(df, "sa", cf.Method(lambda h, *rest: h), 1.0)
    with pytest.raises(ValueError, match="one of"):
        cf.class_plan(df, "sa", "other", 1.0)
