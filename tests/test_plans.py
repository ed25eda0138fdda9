"""Buckets and classes: golden values and randomized re-derivations."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import bucketing, classes, stats, taxonomy
from cloakframe.runtime import materialize

GOLDEN = {"a1": 2, "a2": 6, "b1": 8, "b2": 8}
EDGES = [("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("A", "R"), ("B", "R"),
         ("R", "*"), ("*", "*")]


def histogram(spark, hist):
    rows = spark.createDataFrame([(k, v) for k, v in hist.items()], "sa string, freq bigint")
    total = sum(hist.values())
    return rows.select(
        "sa", "freq", F.lit(total).alias("total"), (F.col("freq") / F.lit(total)).alias("p")
    )


def tree(spark, edges, height):
    return taxonomy.validate_taxonomy(spark.createDataFrame(edges, "child string, parent string"),
                                      height)


def as_buckets(plan):
    out = {}
    for r in plan.collect():
        out.setdefault((r.threshold, r.bucket), ({}, r.freq, r.cap))[0][r.sa] = r.quota
    return {k: out[k] for k in sorted(out)}


def leaves_of(plan, states):
    out = {}
    for r in classes.collect_leaves(plan, states).collect():
        out.setdefault(r.threshold, {}).setdefault((r.level, r.path), {})[r.bucket] = r["size"]
    return {t: {k: dict(sorted(v.items())) for k, v in c.items()} for t, c in out.items()}


def test_golden_beta(spark):
    plan = bucketing.beta_buckets(histogram(spark, GOLDEN), [1.0])
    found = [b for b in as_buckets(plan).values()]
    assert [(sorted(c), f) for c, f, _ in found] == [(["a1"], 2), (["a2"], 6), (["b1", "b2"], 16)]
    assert [c for _, _, c in found] == pytest.approx([1 / 6, 1 / 2, 2 / 3])
    states = materialize(classes.class_states(plan, "likeness"), "t")
    assert leaves_of(plan, states)[1.0] == {(1, 0): {1: 1, 2: 3, 3: 8}, (1, 1): {1: 1, 2: 3, 3: 8}}


def test_golden_overlap(spark):
    paths = tree(spark, EDGES, 2)
    plan = bucketing.overlap_buckets(
        histogram(spark, GOLDEN), [1.0], paths, 2
    )
    found = list(as_buckets(plan).values())
    assert [c for c, _, _ in found] == [{"a1": 2, "a2": 2}, {"a2": 4}, {"b1": 8, "b2": 8}]
    assert [c for _, _, c in found] == pytest.approx([1 / 6, 1 / 3, 2 / 3])
    states = materialize(classes.class_states(plan, "likeness"), "t")
    assert [list(v.values()) for v in leaves_of(plan, states)[1.0].values()] == [[1, 1, 4]] * 4


def test_golden_tclose(spark):
    paths = tree(spark, EDGES, 2)
    plan = bucketing.tclose_buckets(
        histogram(spark, GOLDEN), [0.1, 0.3, 0.6], paths, 2
    )
    found = as_buckets(plan)
    caps = {k: round(c, 6) for k, (_, _, c) in found.items()}
    assert caps == {(0.1, 1): 0, (0.1, 2): 0, (0.3, 1): 0.125, (0.3, 2): 0.166667,
                    (0.6, 1): 0.583333}
    states = materialize(classes.class_states(plan, "emd"), "t")
    sizes = {t: sorted(map(tuple, (v.values() for v in c.values())))
             for t, c in leaves_of(plan, states).items()}
    assert sizes == {0.1: [(1, 2)] * 8, 0.3: [(1, 2)] * 8, 0.6: [(1,)] * 24}
    counted = {r.threshold: r.classes for r in classes.count_classes(states).collect()}
    assert counted == {0.1: 8, 0.3: 8, 0.6: 24}


def random_case(seed):
    """A histogram with ties and a hot value, and a tree of uniform depth."""
    rng = random.Random(seed)
    height = rng.choice([1, 2, 3])
    names, parent = [f"v{i:02d}" for i in range(rng.randint(1, 14))], {"*": "*"}
    hist = {n: rng.choice([1, 2, 2, 3, 5, 8, 13, 40]) for n in names}
    hist[names[0]] += rng.choice([0, sum(hist.values()) // 2])
    layer = names
    for h in range(height - 1):
        groups = rng.randint(1, max(1, len(layer) // 2))
        for i, n in enumerate(layer):
            parent[n] = f"n{h}_{i % groups}"
        layer = [f"n{h}_{i}" for i in range(groups)]
    for n in layer:
        parent[n] = "top"
    parent["top"] = "*"
    return hist, parent, height


@pytest.mark.parametrize("seed", range(6))
def test_random_plans(spark, seed):
    hist, parent, height = random_case(seed)
    limits = [0.3, 1.0, 2.5]
    frame, values = histogram(spark, hist), limits
    paths = tree(spark, list(parent.items()), height)

    plan = materialize(bucketing.beta_buckets(frame, values), "t")
    found = as_buckets(plan)
    for beta in limits:
        got = [(sorted(c), f, k) for (t, _), (c, f, k) in found.items() if t == beta]
        want = plain.beta_buckets(hist, beta)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    check_classes(plan, "likeness", found, limits)

    over = materialize(bucketing.overlap_buckets(frame, values, paths, height), "t")
    found = as_buckets(over)
    for beta in limits:
        got = sorted((sorted(c.items()), round(k, 9)) for (t, _), (c, _, k) in found.items()
                     if t == beta)
        want = sorted((sorted(c), round(k, 9))
                      for c, k in plain.overlap_buckets(hist, parent, height, beta))
        assert got == want
        back = {}
        for content, _ in got:
            for sa, n in content:
                back[sa] = back.get(sa, 0) + n
        assert back == hist
    check_classes(over, "likeness", found, limits)

    close = materialize(bucketing.tclose_buckets(frame, values, paths, height), "t")
    found = as_buckets(close)
    assert sum(f for (t, _), (_, f, _) in found.items() if t == 0.3) == sum(hist.values())
    check_classes(close, "emd", found, limits)


def check_classes(plan, rule, found, limits):
    """States, leaves and seat runs against the recursion by halves."""
    states = materialize(classes.class_states(plan, rule), "t")
    leaves = leaves_of(plan, states)
    seats = {}
    for r in classes.rank_seats(classes.seat_runs(plan, states)).collect():
        seats.setdefault((r.threshold, r.bucket), {})[r.level, r.seq] = (r.first_seat, r["size"])
    for limit in limits:
        sizes = [f for (t, _), (_, f, _) in found.items() if t == limit]
        caps = [c for (t, _), (_, _, c) in found.items() if t == limit]
        good = plain.likeness(caps) if rule == "likeness" else plain.closeness(sizes, caps, limit)
        want = plain.classes(sizes, good)
        got = {k: tuple(v[b] for b in sorted(v)) for k, v in leaves[limit].items()}
        assert got == want
        seq, last = {}, {}
        for level, path in sorted(want):
            seq[level, path] = last[level] = last.get(level, -1) + 1
        for b in range(len(sizes)):
            order = sorted(want, key=lambda k: (-want[k][b], k))
            at, listed = 1, {}
            for key in order:
                if want[key][b]:
                    listed[key[0], seq[key]] = (at, want[key][b])
                    at += want[key][b]
            assert seats.get((limit, b + 1), {}) == listed


def test_many_classes(spark):
    """Enough levels that the frontier is written and spread on the way."""
    hist = {f"v{i}": 3000 + i for i in range(3)}
    frame = histogram(spark, hist)
    plan = materialize(bucketing.beta_buckets(frame, [0.5]), "t")
    states = materialize(classes.class_states(plan, "likeness"), "t")
    leaves = classes.expand_nodes(states)
    counted = classes.count_classes(states).first().classes
    assert leaves.count() == leaves.distinct().count() == counted > 1000
    sizes = {b: f for (_, b), (_, f, _) in as_buckets(plan).items()}
    total = classes.collect_leaves(plan, states).groupBy("bucket").sum("size").collect()
    assert {r[0]: r[1] for r in total} == sizes


def test_min_class_size(spark):
    hist = {"a": 100, "b": 100}
    plan = bucketing.beta_buckets(histogram(spark, hist), [1.0])
    states = classes.class_states(plan, "likeness", min_size=20)
    sizes = classes.collect_leaves(plan, materialize(states, "t"))
    per = sizes.groupBy("level", "path").sum("size").collect()
    assert min(r[2] for r in per) >= 20


def test_taxonomy_validation(spark):
    def check(edges, height=2, values=None):
        frame = spark.createDataFrame(edges, "child string, parent string")
        taxonomy.validate_taxonomy(frame, height, values)

    sa = spark.createDataFrame([("a1",), ("zz",)], "sa string")
    for bad, message in [
        (EDGES[:-1], "root"),
        (EDGES + [("a1", "B")], "two parents"),
        ([e for e in EDGES if e[0] != "A"], "missing"),
        (EDGES + [("c", "R")], "steps below"),
        (EDGES + [("deep", "a1")], "steps below"),
    ]:
        with pytest.raises(ValueError, match=message):
            check(bad)
    with pytest.raises(ValueError, match="not a leaf"):
        check(EDGES, values=sa)
    check(EDGES, values=sa.where("sa = 'a1'"))
    open_ended = taxonomy.ancestor_paths(
        spark.createDataFrame(EDGES, "child string, parent string")
    )
    assert {r.node: r.path for r in open_ended.collect()}["a1"] == ["a1", "A", "R", "*"]


def test_thresholds_positive(spark):
    with pytest.raises(ValueError):
        bucketing.beta_buckets(histogram(spark, GOLDEN), [0.0])


def test_emd_value(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0.5, 0.25), (1, 1, 0.5, 0.25), (1, 2, 0.0, 0.5)], "g int, o int, a double, b double"
    )
    assert stats.emd(rows, ["g"], "o", "a", "b").first()["emd"] == pytest.approx(0.75)


def test_many_values_fill_in_linear_time(spark):
    values = spark.range(1_000_000).select(
        F.format_string("v%07d", "id").alias("sa"), (F.lit(1) + F.col("id") % 3).alias("freq")
    )
    total = 1_999_999
    hist = values.select("sa", "freq", F.lit(total).alias("total"), (F.col("freq") / total).alias("p"))
    plan = bucketing.beta_buckets(hist, [1.0])
    row = plan.agg(F.count("sa"), F.sum("quota"), F.max("bucket"), F.count_distinct("sa")).first()
    assert row[0] == row[3] == 1_000_000 and row[1] == total and 0 < row[2] < 1_000_000
