"""Operators on rows: ranking, Mondrian, centres, pipelines."""

import hashlib
import random

import plain
import pytest
from pyspark.sql import functions as F

import cloakframe as cf
from cloakframe.functions import tie_key
from cloakframe.operators import audit, centers, mondrian, recode, redistribute, stats
from cloakframe.operators.ranking import rank_within
from cloakframe.plans import anonymize as plans
from cloakframe.roles import Roles, check_unique, project_roles
from registry.fixtures import CUST, ORD, cust, ord_, paths

SF = "/root/testdata/sf0.001"


def test_rank_in_cells(spark):
    """A hot group, a value shared by a third of the rows, and negative keys."""
    rng = random.Random(3)
    rows = [
        (i, "hot" if i % 3 else f"g{i % 7}",
         5.0 if rng.random() < 0.35 else round(rng.gauss(0, 50), 1))
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "pid bigint, g string, k double").withColumn(
        "tie", tie_key(F.col("pid"))
    )
    whole = {r.pid: r.rn for r in rank_within(df, ["g"], "k", "tie", 6000).collect()}
    for cell in (40, 500):
        cut = rank_within(df, ["g"], "k", "tie", 6000, cell_rows=cell)
        assert {r.pid: r.rn for r in cut.collect()} == whole
    constant = df.withColumn("k", F.lit(0.0))
    whole = {r.pid: r.rn for r in rank_within(constant, ["g"], "k", "tie", 6000).collect()}
    cut = rank_within(constant, ["g"], "k", "tie", 6000, cell_rows=50)
    assert {r.pid: r.rn for r in cut.collect()} == whole


def test_rank_of_an_empty_part(spark):
    """The known row count may be that of the whole table."""
    df = spark.range(10).select(
        F.col("id").alias("pid"), F.lit(1).alias("g"), F.lit(2.0).alias("k")
    ).withColumn("tie", tie_key(F.col("pid")))
    none = df.where("pid < 0")
    assert rank_within(none, ["g"], "k", "tie", 5000, cell_rows=100).count() == 0
    assert rank_within(df, ["g"], "k", "tie", 5000, cell_rows=100).agg(F.max("rn")).first()[0] == 10


def test_cells_are_small(spark):
    """No window partition of the cut ranking holds a large part of the table."""
    df = spark.range(20000).select(
        F.col("id").alias("pid"), F.lit(1).alias("g"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(1)).alias("k"),
    ).withColumn("tie", tie_key(F.col("pid")))
    ranked = rank_within(df, ["g"], "k", "tie", 20000, cell_rows=1000)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell_range" in plan and "__cell_tie" in plan
    assert ranked.select(F.max("rn"), F.count_distinct("rn")).first()[:] == (20000, 20000)


def _mondrian_rows(rng, n, discrete):
    def value():
        return float(rng.randint(0, 3)) if discrete else rng.gauss(0, 1)

    return [(i, value(), value(), 1.0, f"s{i % 3}") for i in range(n)]


MROLES = Roles("pid", ["a", "b", "c"], "sa")
MSCHEMA = "pid bigint, a double, b double, c double, sa string"


@pytest.mark.parametrize("n, k", [(1, 2), (4, 2), (5, 2), (24, 3), (7, 3), (800, 5)])
def test_mondrian_plain(spark, n, k):
    rows = _mondrian_rows(random.Random(n), n, discrete=n % 2 == 0)
    df = spark.createDataFrame(rows, MSCHEMA)
    scale = stats.fit_scaling(df, MROLES.numeric_qis, sample=True)

    def z(row):
        return [(row[i + 1] - scale.mean[c]) / scale.spread[c] if scale.spread[c] else 0.0
                for i, c in enumerate(MROLES.numeric_qis)]

    want = plain.mondrian(
        [(r[0], hashlib.md5(str(r[0]).encode()).hexdigest(), z(r)) for r in rows], k
    )
    got = mondrian.mondrian_partition(df, MROLES, k)
    assert {r.pid: r.ec for r in got.collect()} == want
    if n > 2 * k:
        sizes = got.groupBy("ec").count().agg(F.min("count"), F.max("count")).first()
        assert k <= sizes[0] and sizes[1] <= 2 * k


@pytest.mark.parametrize("discrete", [False, True])
def test_mondrian_large_groups(spark, discrete):
    """Counting medians in bins gives the groups that sorting gives."""
    rows = _mondrian_rows(random.Random(9), 3000, discrete)
    df = spark.createDataFrame(rows, MSCHEMA).repartition(6)
    local = {r.pid: r.ec for r in mondrian.mondrian_partition(df, MROLES, 4).collect()}
    cut = mondrian.mondrian_partition(df, MROLES, 4, local_rows=500, exact_rows=40)
    assert {r.pid: r.ec for r in cut.collect()} == local
    flat = df.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    local = {r.pid: r.ec for r in mondrian.mondrian_partition(flat, MROLES, 4).collect()}
    cut = mondrian.mondrian_partition(flat, MROLES, 4, local_rows=1500, exact_rows=40)
    assert {r.pid: r.ec for r in cut.collect()} == local


def test_mondrian_holds_no_group_beyond_the_bound(spark, monkeypatch):
    """A caller's number of rows does not bring more of them to a task."""
    df = spark.createDataFrame(_mondrian_rows(random.Random(10), 1500, True), MSCHEMA)
    whole = {r.pid: r.ec for r in mondrian.mondrian_partition(df, MROLES, 4).collect()}
    own, stops = mondrian._split_large, []
    monkeypatch.setattr(mondrian, "_split_large", lambda rows, dims, stop, exact: stops.append(stop) or own(rows, dims, stop, exact))
    monkeypatch.setattr(mondrian, "MAX_LOCAL_ROWS", 800)
    made = mondrian.mondrian_partition(df, MROLES, 4, local_rows=1 << 30)
    assert {r.pid: r.ec for r in made.collect()} == whole and stops == [800]


def test_mondrian_needs_k(spark):
    with pytest.raises(ValueError):
        mondrian.mondrian_partition(cust(spark, SF), CUST, 1)


def assigned(spark, df, roles, method, threshold, **options):
    tree = paths(spark, SF) if method != "beta" else None
    made = plans.class_plan(df, roles.sa, method, threshold, tree, 2)
    return made, plans.assign_classes(df, roles, made, **options)


@pytest.mark.parametrize("method, threshold", [("beta", 0.5), ("overlap", 3.0), ("tclose", 0.5)])
def test_pipeline_invariants(spark, method, threshold):
    df = ord_(spark, SF).cache()
    n = df.count()
    made, rows = assigned(spark, df, ORD, method, threshold)
    rows = rows.cache()
    assert rows.count() == rows.select("o_orderkey").distinct().count() == n
    plan = made.plan.collect()
    assert sum(r.quota for r in plan) == n
    quota = {(r.bucket, r.sa): r.quota for r in plan}
    held = rows.groupBy("bucket", "n_name").count().collect()
    assert {(r.bucket, r.n_name): r["count"] for r in held} == quota
    planned = {}
    for r in made.runs.collect():
        for i in range(r.classes):
            planned[r.bucket, 2**r.level + r.first_seq + i] = r["size"]
    got = rows.groupBy("bucket", "ec").count().collect()
    assert {(r.bucket, r.ec): r["count"] for r in got} == planned
    assert rows.select("ec").distinct().count() == made.classes
    # The same rows under other partitionings and with the ranks cut in cells.
    want = {r.o_orderkey: r.ec for r in rows.collect()}
    for parts in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        _, again = assigned(spark, df.repartition(parts), ORD, method, threshold, cell_rows=200)
        assert {r.o_orderkey: r.ec for r in again.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    # Released values are constant in a class and keep the mean of the table.
    mean = recode.recode_mean(rows, ORD, keep_pid=True, classes=made.classes)
    joined = mean.join(rows.select("o_orderkey", "ec"), "o_orderkey")
    spread = joined.groupBy("ec").agg(F.countDistinct("c_acctbal").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1
    avg = [f.agg(F.avg("o_totalprice")).first()[0] for f in (mean, df)]
    assert avg[0] == pytest.approx(avg[1])
    # The join that does not broadcast the classes gives the same release.
    other = recode.recode_mean(rows, ORD, keep_pid=True)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, mean.collect()))


def test_likeness_holds(spark):
    made, rows = assigned(spark, cust(spark, "/root/testdata/sf0.01"), CUST, "beta", 1.0)
    per = rows.groupBy("ec", "bucket").count().withColumn(
        "share", F.col("count") / F.sum("count").over(plans_window())
    )
    caps = made.plan.select("bucket", "cap").distinct()
    broken = per.join(caps, "bucket").where(
        F.floor(F.col("share") * 100 + 0.5) > F.floor(F.col("cap") * 100 + 0.5)
    )
    assert made.classes == 8 and broken.isEmpty()
    assert audit.cap_excess(
        audit.skew_per_sa(audit.class_value_counts(rows, "n_name")), 1.0
    ).columns == ["ec", "value", "p_class", "cap"]


def plans_window():
    from pyspark.sql import Window

    return Window.partitionBy("ec")


def test_single_value_and_constant_qi(spark):
    df = spark.range(50).select(
        F.col("id").alias("pid"), F.lit(7.0).alias("q"), F.lit("only").alias("sa")
    )
    roles = Roles("pid", ["q"], "sa")
    out = cf.anonymize(df, roles, "beta", 1.0, keep_pid=True)
    assert out.count() == 50 and {r.q for r in out.collect()} == {7.0}
    loss = audit.information_loss(
        plans.assign_classes(df, roles, plans.class_plan(df, "sa", "beta", 1.0)), ["q"]
    ).first()
    assert loss["information_loss"] == 0.0


def test_bad_input_is_rejected(spark):
    twice = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], "pid int, q double, sa string")
    roles = Roles("pid", ["q"], "sa")
    with pytest.raises(ValueError, match="not unique"):
        check_unique(twice, roles)
    with pytest.raises(ValueError, match="null"):
        cf.anonymize(twice.withColumn("q", F.lit(None).cast("double")), roles, "beta", 1.0)
    with pytest.raises(ValueError, match="method"):
        cf.anonymize(twice, roles, "other", 1.0, check=False)
    with pytest.raises(ValueError, match="taxonomy"):
        cf.anonymize(twice, roles, "tclose", 1.0, check=False)
    with pytest.raises(ValueError):
        Roles("pid", ["pid"], "sa")
    with pytest.raises(ValueError, match="empty"):
        cf.class_plan(twice.limit(0), "sa", "beta", 1.0)


def test_one_class_warns(spark):
    with pytest.warns(UserWarning, match="single class"):
        made = cf.class_plan(cust(spark, SF), "n_name", "tclose", 0.1, paths(spark, SF), 2)
    assert made.classes == 1


def test_recode_many_classes(spark, monkeypatch):
    """Top-level classes broadcast, the rest by a shuffled join."""
    rows = plans.assign_classes(
        cust(spark, SF), CUST, cf.class_plan(cust(spark, SF), "n_name", "beta", 0.5)
    ).cache()
    whole = sorted(map(tuple, recode.recode_median(rows, CUST, True, 5).collect()))
    monkeypatch.setattr(recode, "TOP_CLASSES", 6)
    assert sorted(map(tuple, recode.recode_median(rows, CUST, True, 7).collect())) == whole


def test_nearest_center_in_parts(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random(), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "pid int, x double, y double, g int")
    middle = [(i, rng.random(), rng.random(), i % 2) for i in range(40)]
    table = spark.createDataFrame(middle, "center int, x double, y double, g int")

    def best(row, grouped):
        return min(
            ((row[1] - c[1]) ** 2 + (row[2] - c[2]) ** 2, c[0])
            for c in middle if not grouped or c[3] == row[3]
        )

    for grouped in (False, True):
        for size in (1 << 20, 300):
            near = centers.nearest_center(
                df, ["x", "y"], table, group="g" if grouped else None, max_bytes=size
            )
            got = {r.pid: (r.distance, r.center) for r in near.collect()}
            for row in rows:
                want = best(row, grouped)
                assert got[row[0]][1] == want[1] and got[row[0]][0] == pytest.approx(want[0])


def test_assignment_to_centers_keeps_capacities(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), 1 + i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "pid int, x double, bucket bigint")
    middle = spark.createDataFrame([(e, e / 4) for e in range(4)], "ec bigint, x double")
    room = spark.createDataFrame(
        [(e, b, n) for b in (1, 2) for e, n in enumerate((5, 20, 15, 10))],
        "ec bigint, bucket bigint, size bigint",
    )
    out = centers.redistribute_by_center(df, ["x"], "pid", middle, room)
    got = {(r.ec, r.bucket): r["count"] for r in out.groupBy("ec", "bucket").count().collect()}
    assert got == {(r.ec, r.bucket): r["size"] for r in room.collect()}
    assert out.select("pid").distinct().count() == 100
    with pytest.raises(ValueError, match="capacities"):
        centers.redistribute_by_center(df, ["x"], "pid", middle, room.where("ec > 1"))


def test_sweep_skips_the_start(spark):
    swept = cf.threshold_sweep(cust(spark, SF), "n_name", "beta", 0.0, 1.0, 0.25).collect()
    assert sorted(r.threshold for r in swept) == [0.25, 0.5, 0.75, 1.0]
    assert {r.classes for r in swept if r.threshold == 0.5} == {5}


def test_rows_keep_role_types(spark):
    df = project_roles(cust(spark, SF), CUST)
    assert dict(df.dtypes)["c_acctbal"] == "double" and dict(df.dtypes)["n_name"] == "string"
    scaling = stats.fit_scaling(df, ["c_acctbal"])
    keyed = redistribute.with_norm_key(df, CUST, scaling)
    assert dict(keyed.dtypes)["__key"] == "bigint"


def test_mixed_seeds(spark):
    from cloakframe.operators import taxonomy

    rng = random.Random(8)
    rows = [(i, rng.gauss(10 * (i % 3), 0.1), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "pid int, x double, c string")
    tree = taxonomy.ancestor_paths(
        spark.createDataFrame([("a", "t"), ("b", "t"), ("t", "*"), ("*", "*")],
                              "child string, parent string"), 1
    )
    seeds = centers.seed_centers_mixed(df, ["x"], [("c", 1)], tree, "pid", 6).collect()
    assert len({s.pid for s in seeds}) == 6 and [s.pick for s in seeds] == list(range(6))
    assert sum(s.weight for s in seeds) <= 300
    # k-means++ on three spots and two values: no two seeds stand for the same.
    assert len({(round(s.x / 10), s.c) for s in seeds}) == 6
    again = centers.seed_centers_mixed(df.repartition(5), ["x"], [("c", 1)], tree, "pid", 6)
    assert {s.pid for s in again.collect()} == {s.pid for s in seeds}


def test_mismatch_counts(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 0.9, "b")], "pid int, x double, c string")
    middle = spark.createDataFrame([(1, 0.0, "b"), (2, 1.0, "a")], "center int, x double, c string")
    near = centers.nearest_center(df, ["x"], middle, mismatch={"c": 0.7}).collect()
    assert {r.pid: (r.center, round(r.distance, 6)) for r in near} == {1: (1, 0.7), 2: (2, 0.71)}


@pytest.mark.parametrize("groups", [["g"], []])
def test_null_and_nan_keys_rank_alike(spark, groups):
    rng = random.Random(12)
    nan = float("nan")
    rows = [(i, i % 2, rng.choice([nan, None, 1.5, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "pid int, g int, k double").withColumn("t", F.md5(F.col("pid").cast("string")))
    plain = {r.pid: r.rn for r in rank_within(df, groups, "k", "t", 400).collect()}
    cells = {r.pid: r.rn for r in rank_within(df, groups, "k", "t", 400, cell_rows=20).collect()}
    assert cells == plain and len(cells) == 400


def test_values_that_are_not_finite_are_rejected(spark):
    for bad in (float("nan"), float("inf")):
        df = spark.createDataFrame([(1, 1.0, "a"), (2, bad, "b")], "pid int, x double, sa string")
        with pytest.raises(ValueError, match="not finite"):
            cf.anonymize(df, cf.Roles("pid", ["x"], "sa"), "beta", 1.0)


def test_dates_count_days(spark):
    df = spark.sql("SELECT 1 AS pid, DATE'1970-01-11' AS d, 'a' AS sa")
    assert project_roles(df, cf.Roles("pid", ["d"], "sa")).first().d == 10.0


def test_every_class_gets_a_centre(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(60)], "x double")
    sizes = spark.createDataFrame([(e, 10 + e) for e in range(5)], "ec bigint, size bigint")
    for make in (centers.class_centers_kmeans, centers.class_centers_random):
        made = {r.ec: (r.cluster, r.x) for r in make(df, ["x"], sizes).collect()}
        assert {e: c for e, (c, _) in made.items()} == {e: 4 - e for e in range(5)}
    with pytest.raises(ValueError, match="clusters for 5 classes"):
        centers.class_centers_kmeans(df, ["x"], sizes, strict=True)


def test_cycles_are_found_and_deep_trees_pass(spark):
    from cloakframe.operators import taxonomy

    schema = "child string, parent string"
    deep = [(str(i), str(i + 1)) for i in range(70)] + [("70", "*"), ("*", "*")]
    paths = taxonomy.ancestor_paths(spark.createDataFrame(deep, schema))
    assert paths.where("node = '0'").first().path[-1] == "*"
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.ancestor_paths(spark.createDataFrame([("a", "b"), ("b", "a"), ("*", "*")], schema))


def test_long_runs_are_listed_in_chunks(spark, monkeypatch):
    from cloakframe.operators import classes

    monkeypatch.setattr(classes, "CHUNK_CLASSES", 7)
    runs = spark.createDataFrame(
        [(1.0, 1, 2, 3, 50, 5, 0)],
        "threshold double, bucket bigint, size bigint, level int, classes bigint, first_seq bigint, row_lo bigint",
    )
    assert sorted(r.seq for r in classes.rank_seats(runs).collect()) == list(range(5, 55))
    assert sorted(r.seat for r in classes.expand_seats(runs).collect()) == list(range(1, 101))


def test_intermediate_tables_are_removed(spark):
    from cloakframe.runtime import _written, discard_all

    discard_all(spark)
    df = spark.createDataFrame([(i, float(i * 37 % 400), "a") for i in range(400)], "pid int, x double, sa string")
    made = mondrian.mondrian_partition(df, cf.Roles("pid", ["x"], "sa"), 2, local_rows=8)
    assert made.groupBy("ec").count().count() >= 100
    left = [p for p in _written[spark.sparkContext.applicationId] if "/halves-" in p or "/standardized-" in p]
    assert len(left) == 1
    assert discard_all(spark) > 0 and not _written[spark.sparkContext.applicationId]


def test_class_distances_in_parts(spark):
    rng = random.Random(14)
    rows = [(e, f"v{rng.randint(0, 30):02d}", rng.randint(1, 9)) for e in range(12) for _ in range(9)]
    rows.append((99, "v00", 4))
    counts = spark.createDataFrame(rows, "ec bigint, value string, n bigint").groupBy("ec", "value").agg(F.sum("n").alias("n"))
    held = {(r.ec, r.value): r.n for r in counts.collect()}
    values = sorted({v for _, v in held})
    total = sum(held.values())
    for options in ({}, {"part_values": 4, "cell_rows": 5}):
        got = {r.ec: r.emd for r in audit.emd_per_class(counts, **options).collect()}
        assert set(got) == {e for e, _ in held}
        for e in got:
            size, run, want = sum(n for (c, _), n in held.items() if c == e), 0.0, 0.0
            for v in values:
                run += held.get((e, v), 0) / size - sum(n for (_, x), n in held.items() if x == v) / total
                want += abs(run)
            assert got[e] == pytest.approx(want)


def test_a_long_chain_takes_few_rounds(spark):
    from cloakframe.operators import taxonomy

    long = 10_000
    edges = spark.range(long).selectExpr(
        "CAST(id AS STRING) AS child", f"IF(id = {long - 1}, '*', CAST(id + 1 AS STRING)) AS parent"
    ).union(spark.createDataFrame([("*", "*")], "child string, parent string"))
    paths = taxonomy.ancestor_paths(edges)
    sizes = paths.selectExpr("node", "size(path) AS n", "element_at(path, -1) AS top").collect()
    assert len(sizes) == long + 1
    assert all(r.n == long - int(r.node) + 1 and r.top == "*" for r in sizes if r.node != "*")


def test_orphans_and_loops_of_one(spark):
    from cloakframe.operators import taxonomy

    schema = "child string, parent string"
    found = taxonomy.ancestor_paths(spark.createDataFrame([("a", "b"), ("b", "gone"), ("c", "*"), ("*", "*")], schema))
    assert {r.node: r.path for r in found.collect()} == {
        "a": ["a", "b", "gone", None], "b": ["b", "gone", None], "c": ["c", "*"], "*": ["*"]
    }
    with pytest.raises(ValueError, match="cycle at 'x'"):
        taxonomy.ancestor_paths(spark.createDataFrame([("x", "x"), ("*", "*")], schema))
    assert taxonomy.ancestor_paths(spark.createDataFrame([], schema)).count() == 0


def test_distance_at_different_depths(spark):
    from cloakframe.operators import taxonomy

    edges = [("a1", "a"), ("a2", "a"), ("a", "top"), ("b", "top"), ("top", "*"), ("*", "*")]
    paths = taxonomy.ancestor_paths(spark.createDataFrame(edges, "child string, parent string"))
    pairs = [("a1", "a2", 1), ("a1", "b", 2), ("b", "a1", 2), ("a", "b", 1), ("a1", "a1", 0), ("a", "a1", 1), ("top", "a2", 2)]
    df = spark.createDataFrame(pairs, "l string, r string, want int")
    for row in taxonomy.taxonomy_distance(df, [("l", "r", 2)], paths).collect():
        assert row.distance == row.want / 2
