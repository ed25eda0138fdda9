"""One query per operator, each with its SQL where SQL can say it.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLES[name]`` is the
same result for DuckDB. Floating-point results are rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions import likeness_cap, round_half_up
from cloakframe.operators import audit, bucketing, centers, classes, mondrian, recode
from cloakframe.operators import redistribute as redist
from cloakframe.operators import stats, taxonomy
from cloakframe.plans import anonymize as plans
from cloakframe.roles import Roles, drop_sensitive, project_roles
from cloakframe.runtime import materialize, scratch_path
from cloakframe.sources import microdata

from . import oracles as sql
from .fixtures import CUST, EVT, HEIGHT, ORD, cust, edges, emb, evt, ord_, paths, segment_edges
from .fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BETA_CUST = 0.5
BETA_ORD = 0.5
BETA_WIDE = 1.0
OVERLAP = 3.0
CLOSE = 0.5
K = 5


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__.rstrip("_")] = fn
        if oracle is not None:
            ORACLES[fn.__name__.rstrip("_")] = oracle
        return fn

    return add


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.51)).cast("double") / F.lit(1e6)


def lng(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def cust_classes(spark, d, beta=BETA_CUST):
    return plans.class_plan(cust(spark, d), "n_name", "beta", beta)


def cust_assigned(spark, d, beta=BETA_CUST):
    return plans.assign_classes(cust(spark, d), CUST, cust_classes(spark, d, beta))


def evt_assigned(spark, d, beta):
    made = plans.class_plan(evt(spark, d), "event_type", "beta", beta)
    return plans.assign_classes(evt(spark, d), EVT, made)


def ord_made(spark, d, method="beta", threshold=BETA_ORD):
    """Classes of the orders and the assigned rows."""
    tree = paths(spark, d) if method != "beta" else None
    made = plans.class_plan(ord_(spark, d), "n_name", method, threshold, tree, HEIGHT)
    return made, plans.assign_classes(ord_(spark, d), ORD, made)


def ord_assigned(spark, d, method="beta", threshold=BETA_ORD):
    return ord_made(spark, d, method, threshold)[1]


def class_seats(made):
    """(ec, bucket, size): the seats of every class."""
    ec = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")) + F.col("seq")
    return classes.rank_seats(made.runs).select(ec.alias("ec"), "bucket", "size")


CUST_PLAN = sql.beta_plan("cust", sql.CUST, [BETA_CUST])
CUST_SEATS = [*CUST_PLAN, sql.tree("likeness"), sql.SEATS]
CUST_ASSIGNED = sql.assigned(CUST_PLAN, "likeness", "cust", 1)
EVT_ASSIGNED = sql.assigned(
    sql.beta_plan("evt", sql.EVT, [BETA_CUST]), "likeness", "evt", 3
)
ORD_PLAN = sql.beta_plan("ord", sql.ORD, [BETA_ORD])
ORD_ASSIGNED = sql.assigned(ORD_PLAN, "likeness", "ord", 3)
OVER_PLAN = sql.overlap_plan("ord", sql.ORD, [OVERLAP])
OVER_ASSIGNED = sql.assigned(OVER_PLAN, "likeness", "ord", 3, quotas=True)
CLOSE_PLAN = sql.tclose_plan("ord", sql.ORD, [CLOSE])
CLOSE_ASSIGNED = sql.assigned(CLOSE_PLAN, "emd", "ord", 3)

# ---------------------------------------------------------------- sources


@query(sql.with_(sql.CUST) + "SELECT pid AS c_custkey, q1 AS c_acctbal, cat AS c_mktsegment, "
       "sa AS n_name FROM cust")
def load_microdata(spark, d):
    path = scratch_path(spark, "microdata")
    cust(spark, d).write.csv(path)
    read = microdata.load_microdata(
        spark, path, CUST, "csv", ["c_custkey", "c_acctbal", "c_mktsegment", "n_name"]
    )
    return read.withColumn("c_custkey", lng("c_custkey"))


@query(sql.with_(sql.CUST) + """SELECT CAST(pid AS VARCHAR) AS c_custkey, q1 AS c_acctbal, sa AS n_name,
  CASE WHEN pid % 11 = 0 THEN 'wrong number of fields' WHEN pid % 7 = 0 THEN 'c_acctbal: not a number'
    WHEN pid % 5 = 0 THEN 'c_acctbal: not finite' WHEN pid % 3 = 0 THEN 'n_name: missing' END AS reason
FROM cust""")
def load_with_rejects(spark, d):
    """The customers as text with faults; good and rejected rows with the reason."""
    path = scratch_path(spark, "faulty")
    key, number = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    said = F.when(key % 7 == 0, F.concat(number, F.lit("?"))).when(key % 5 == 0, "Infinity").otherwise(number)
    name = F.when(key % 3 == 0, "").otherwise(F.col("n_name"))
    fields = F.concat_ws(",", key, said, "c_mktsegment", name)
    line = F.when(key % 11 == 0, F.concat_ws(",", key, said)).otherwise(fields)
    cust(spark, d).select(line.alias("value")).write.text(path)
    names = ["c_custkey", "c_acctbal", "c_mktsegment", "n_name"]
    load = microdata.load_with_rejects(spark, path, CUST, "csv", names)
    told = load.rows.select(F.col("c_custkey").cast("string"), F.lit(None).cast("string").alias("reason")).unionByName(
        load.rejects.select("c_custkey", "reason")
    )
    whole = cust(spark, d).select(F.col("c_custkey").cast("string"), "c_acctbal", "n_name")
    return told.join(whole, "c_custkey").select("c_custkey", "c_acctbal", "n_name", "reason")


@query(sql.with_(sql.CUST) + """
SELECT i AS column_index, bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) AS is_numeric,
       CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 0 ELSE max(h) END AS height
FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest([CAST(pid AS VARCHAR), CAST(q1 AS VARCHAR), cat, sa])
      AS v, unnest([0, 0, 1, 2]) AS h FROM cust) GROUP BY i""")
def load_descriptor(spark, d):
    """A descriptor derived from the table's text, written, and read back."""
    path = scratch_path(spark, "descriptor")
    names = ["c_custkey", "c_acctbal", "c_mktsegment", "n_name"]
    heights = [0, 0, 1, HEIGHT]
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"), F.lit(h).alias("h"))
        for i, (c, h) in enumerate(zip(names, heights))
    ]))
    numeric = F.bool_and(F.col("v").try_cast("double").isNotNull())
    described = cust(spark, d).select(cells).groupBy("i").agg(
        numeric.alias("numeric"), F.max("h").alias("h")
    )
    described.select(
        "i", F.col("numeric").cast("int"), F.when(F.col("numeric"), 0).otherwise(F.col("h"))
    ).write.csv(path)
    return microdata.load_descriptor(spark, path).withColumnRenamed("index", "column_index")


@query(sql.with_(sql.EDGES) + "SELECT child, parent FROM edges")
def load_taxonomy(spark, d):
    path = scratch_path(spark, "taxonomy")
    edges(spark, d).write.csv(path)
    return microdata.load_taxonomy(spark, path)


@query("SELECT * , count(*) AS copies FROM events GROUP BY ALL")
def row_id(spark, d):
    """Equal rows share the id: rows per id."""
    events = table(spark, d, "events")
    rows = microdata.with_row_id(events)
    return rows.groupBy("row_id").agg(
        *[F.min(c).alias(c) for c in events.columns], F.count(F.lit(1)).alias("copies")
    ).drop("row_id")


_RELEASE = sql.with_(*CUST_ASSIGNED) + f"""
SELECT {sql.r6("avg(q1) OVER (PARTITION BY ec)")} AS c_acctbal, cat AS c_mktsegment,
       sa AS n_name FROM assigned"""


@query(_RELEASE)
def write_release(spark, d):
    released = plans.anonymize(cust(spark, d), CUST, "beta", BETA_CUST)
    path = scratch_path(spark, "release")
    microdata.write_release(released, path)
    back = spark.read.schema(released.schema).parquet(path)
    return back.withColumn("c_acctbal", r6("c_acctbal"))


@query(sql.with_(*CUST_ASSIGNED) + "SELECT pid AS c_custkey, ec FROM assigned")
def assigned_roundtrip(spark, d):
    path = scratch_path(spark, "assigned")
    microdata.write_assigned(cust_assigned(spark, d), path)
    return microdata.read_assigned(spark, path).select("c_custkey", "ec")


# ------------------------------------------------- projections, expansion


@query("SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id, event_type FROM events")
def project_roles_(spark, d):
    return project_roles(
        table(spark, d, "events"), Roles("event_id", ["value", "user_id"], "event_type")
    )


@query("SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id FROM events")
def drop_sensitive_(spark, d):
    return drop_sensitive(
        table(spark, d, "events"), Roles("event_id", ["value", "user_id"], "event_type")
    )


@query(sql.with_(*sql.beta_plan("ord", sql.ORD, [BETA_WIDE]))
       + "SELECT bucket, sa, freq FROM plan WHERE freq > 0")
def nonempty_buckets(spark, d):
    plan = plans.bucket_plan(ord_(spark, d), "n_name", "beta", [BETA_WIDE])
    return bucketing.nonempty_buckets(plan).select(lng("bucket").alias("bucket"), "sa", "freq")


@query(sql.with_(*sql.tclose_plan("cust", sql.CUST, [CLOSE]))
       + "SELECT bucket, sa, quota FROM plan")
def explode_buckets(spark, d):
    return plans.bucket_plan(
        cust(spark, d), "n_name", "tclose", [CLOSE], paths(spark, d), HEIGHT
    ).select("bucket", "sa", "quota")


@query(sql.with_(*CUST_SEATS) + """
SELECT bucket, CAST(level AS BIGINT) AS level, seq, size,
       unnest(range(first_seat, first_seat + size)) AS seat FROM seats""")
def expand_slots(spark, d):
    made = cust_classes(spark, d)
    return classes.expand_seats(made.runs).select(
        "bucket", lng("level").alias("level"), "seq", "size", "seat"
    )


# ---------------------------------------------------------------- taxonomy


@query(sql.with_(sql.EDGES, sql.CLOSURE) + "SELECT node, ancestor, height FROM closure")
def taxonomy_closure(spark, d):
    tree = taxonomy.validate_taxonomy(edges(spark, d), HEIGHT, cust(spark, d).select("n_name"))
    return taxonomy.taxonomy_closure(tree)


@query(sql.with_(sql.CUST) + "SELECT pid AS c_custkey, sa AS n_name, region AS parent, "
       "'ALL' AS grandparent FROM cust")
def ancestor_at(spark, d):
    tree = paths(spark, d)
    rows = cust(spark, d).select("c_custkey", "n_name")
    one = taxonomy.ancestor_at(rows, "n_name", tree, 1, "parent")
    return taxonomy.ancestor_at(one, "n_name", tree, 2, "grandparent")


@query("SELECT n_name AS node, count(c_custkey) AS customers FROM nation "
       "LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def descendants_at(spark, d):
    below = taxonomy.descendants_at(paths(spark, d), "ALL", 2)
    counts = cust(spark, d).groupBy(F.col("n_name").alias("node")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    return below.join(counts, "node", "left").withColumn(
        "customers", F.coalesce("customers", F.lit(0))
    )


@query(sql.with_(sql.ORD) + "SELECT pid AS o_orderkey, region AS place FROM ord")
def generalize_to_level(spark, d):
    rows = ord_(spark, d).select("o_orderkey", "n_name")
    return taxonomy.generalize_to_level(
        rows, "n_name", paths(spark, d), 1, HEIGHT, "place"
    ).drop("n_name")


def _trade(spark, d):
    """Lines with the nations of buyer and seller."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    nation = table(spark, d, "nation")
    buyer = nation.select(F.col("n_nationkey").alias("bk"), F.col("n_name").alias("buyer"))
    seller = nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("seller"))
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(buyer, customer.c_nationkey == F.col("bk"))
        .join(seller, supplier.s_nationkey == F.col("sk"))
        .select("l_quantity", "buyer", "seller")
    )


@query("""SELECT buyer, seller, distance, count(*) AS lines FROM (
  SELECT b.n_name AS buyer, s.n_name AS seller,
    CASE WHEN b.n_name = s.n_name THEN 0.0::DOUBLE
         WHEN b.n_regionkey = s.n_regionkey THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS distance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON c_nationkey = b.n_nationkey
  JOIN nation s ON s_nationkey = s.n_nationkey) GROUP BY buyer, seller, distance""")
def taxonomy_distance(spark, d):
    far = taxonomy.taxonomy_distance(
        _trade(spark, d), [("buyer", "seller", HEIGHT)], paths(spark, d)
    )
    return far.groupBy("buyer", "seller", "distance").agg(F.count(F.lit(1)).alias("lines"))


@query(sql.with_(sql.CUST, """near AS (
  SELECT DISTINCT n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)""")
       + """SELECT pid AS c_custkey,
  min(CASE WHEN sa = n_name THEN 0.0::DOUBLE WHEN region = r_name THEN 0.5::DOUBLE
           ELSE 1.0::DOUBLE END) AS distance
  FROM cust, near GROUP BY pid""")
def taxonomy_distance_nearest(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    near = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("n_name")
    return taxonomy.taxonomy_distance_nearest(
        cust(spark, d).select("c_custkey", "n_name"), [("n_name", HEIGHT)], near, paths(spark, d)
    ).select("c_custkey", "distance")


# ------------------------------------------------------------------- joins


@query(sql.with_(*OVER_PLAN) + "SELECT pid AS o_orderkey, bucket FROM ord JOIN plan USING (sa)")
def join_bucket(spark, d):
    rows = project_roles(ord_(spark, d), ORD)
    plan = plans.bucket_plan(rows, "n_name", "overlap", [OVERLAP], paths(spark, d), HEIGHT)
    return redist.join_bucket(rows, ORD, plan, plan.count()).select("o_orderkey", "bucket")


@query(sql.with_(*CUST_ASSIGNED) + "SELECT pid AS c_custkey, bucket, "
       "CAST(level AS BIGINT) AS level, seq FROM assigned")
def join_seat(spark, d):
    made = cust_classes(spark, d)
    ranked = redist.rank_rows(project_roles(cust(spark, d), CUST), CUST, made.plan)
    return redist.join_seat(ranked, made.runs, 2 * made.levels * made.plan.count()).select(
        "c_custkey", "bucket", lng("ec_level").alias("level"), F.col("ec_seq").alias("seq")
    )


@query(sql.with_(*CUST_ASSIGNED) + "SELECT pid AS c_custkey, c_name, ec FROM assigned "
       "JOIN customer ON c_custkey = pid")
def join_back_rows(spark, d):
    """Classes joined with a column that was not part of the run."""
    made = cust_assigned(spark, d).select("c_custkey", "ec")
    return made.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query(sql.with_(*CUST_ASSIGNED) + f"""SELECT pid AS c_custkey, ec,
  {sql.r6("avg(q1) OVER (PARTITION BY ec)")} AS mean FROM assigned""")
def join_ec_means(spark, d):
    rows = cust_assigned(spark, d)
    means = stats.ec_means(rows, ["c_acctbal"]).withColumnRenamed("c_acctbal", "mean")
    return rows.select("c_custkey", "ec").join(means, "ec").withColumn("mean", r6("mean"))


ORD_MONDRIAN = [sql.ORD, sql.mondrian("ord", 3, K)]


@query(sql.with_(*ORD_MONDRIAN) + "SELECT pid AS o_orderkey, o_orderstatus, ec FROM grouped "
       "JOIN orders ON o_orderkey = pid")
def join_group_id(spark, d):
    made = mondrian.mondrian_partition(ord_(spark, d), ORD, K).select("o_orderkey", "ec")
    return made.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query(sql.with_(sql.ORD, sql.EDGES, sql.CLOSURE, sql.hist("ord"), sql.tcost()) + f"""
SELECT h.sa, h.freq, {sql.r6("h.p")} AS p FROM hist h
WHERE NOT EXISTS (SELECT 1 FROM sacost c WHERE c.sa = h.sa AND c.level >= 2
                  AND c.cost < {CLOSE})""")
def join_frontier(spark, d):
    """Values still to be split after the top level, with their counts."""
    histogram = stats.sa_histogram(ord_(spark, d), "n_name")
    open_ = bucketing.frontier_at(histogram, paths(spark, d), HEIGHT, 2, CLOSE)
    return open_.select("sa", "freq", r6("p").alias("p"))


# -------------------------------------------------------------- aggregates


@query(sql.with_(sql.ORD, sql.hist("ord")) + f"SELECT sa, freq, {sql.r6('p')} AS p FROM hist")
def sa_histogram(spark, d):
    return stats.sa_histogram(ord_(spark, d), "n_name").select("sa", "freq", r6("p").alias("p"))


@query(sql.with_(sql.ORD, sql.hist("ord"), sql.thresholds([BETA_WIDE]), sql.CAPS)
       + f"SELECT sa, {sql.r6('cap')} AS cap FROM caps")
def likeness_cap_(spark, d):
    histogram = stats.sa_histogram(ord_(spark, d), "n_name")
    return histogram.select("sa", r6(likeness_cap(F.col("p"), BETA_WIDE)).alias("cap"))


@query(sql.with_(sql.ORD, sql.EDGES, sql.CLOSURE, sql.hist("ord"), sql.tcost())
       + f"SELECT sa, CAST(level AS BIGINT) AS level, node, {sql.r6('cost')} AS cost FROM sacost")
def hierarchy_cost(spark, d):
    histogram = stats.sa_histogram(ord_(spark, d), "n_name")
    return bucketing.hierarchy_cost(histogram, paths(spark, d), HEIGHT).select(
        "sa", lng("level").alias("level"), "node", r6("cost").alias("cost")
    )


@query(sql.with_(*CUST_SEATS) + """
SELECT 'table' AS counted, count(*) AS rows FROM cust
UNION ALL SELECT 'buckets', CAST(sum(freq) AS BIGINT) FROM buckets
UNION ALL SELECT 'classes', CAST(sum(size) AS BIGINT) FROM seats""")
def row_count(spark, d):
    """Rows of the table, of all buckets and of all classes."""
    made = cust_classes(spark, d)
    in_buckets = classes.bucket_sizes(made.plan).agg(F.sum("freq").alias("rows"))
    in_classes = made.runs.agg(F.sum(F.col("size") * F.col("classes")).alias("rows"))
    parts = {"table": stats.row_count(cust(spark, d)), "buckets": in_buckets,
             "classes": in_classes}
    listed = [p.select(F.lit(n).alias("counted"), lng("rows").alias("rows"))
              for n, p in parts.items()]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {sql.r6(f'avg({c})')} AS mean, "
    f"{sql.r6(f'var_samp({c}) / 1e6')} AS variance_e6, min({c}) AS low, max({c}) AS high "
    "FROM lineitem" for c in _LINE))
def column_stats(spark, d):
    found = stats.column_stats(table(spark, d, "lineitem"), _LINE)
    return found.select(
        F.col("column").alias("column_name"),
        r6("mean").alias("mean"),
        r6(F.col("variance") / 1e6).alias("variance_e6"),
        F.col("min").alias("low"),
        F.col("max").alias("high"),
    )


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {sql.r6(f'avg({c})')} AS mean, "
    f"{sql.r6(f'var_pop({c}) / 1e6')} AS variance_e6 FROM lineitem" for c in _LINE))
def population_stats(spark, d):
    found = stats.population_stats(table(spark, d, "lineitem"), _LINE)
    return found.select(
        F.col("column").alias("column_name"),
        r6("mean").alias("mean"),
        r6(F.col("variance") / 1e6).alias("variance_e6"),
    )


@query(sql.with_(*ORD_ASSIGNED) + "SELECT ec, count(*) AS size FROM assigned GROUP BY ec")
def ec_sizes(spark, d):
    return stats.ec_sizes(ord_assigned(spark, d))


@query(sql.with_(*ORD_ASSIGNED) + f"""SELECT ec, {sql.r6("avg(q1)")} AS price,
  {sql.r6("avg(q2)")} AS day, {sql.r6("avg(q3)")} AS balance FROM assigned GROUP BY ec""")
def ec_means(spark, d):
    means = stats.ec_means(ord_assigned(spark, d), ORD.numeric_qis)
    return means.select(
        "ec",
        r6("o_totalprice").alias("price"),
        r6("o_day").alias("day"),
        r6("c_acctbal").alias("balance"),
    )


@query(sql.with_(*ORD_ASSIGNED) + """SELECT ec, count(*) AS size, min(q1) AS o_totalprice_min,
  max(q1) AS o_totalprice_max, min(q2) AS o_day_min, max(q2) AS o_day_max,
  min(q3) AS c_acctbal_min, max(q3) AS c_acctbal_max FROM assigned GROUP BY ec""")
def ec_ranges(spark, d):
    return stats.ec_ranges(ord_assigned(spark, d), ORD.numeric_qis)


@query(sql.with_(sql.ORD, sql.norms("ord", 3)) + f"""SELECT pid AS o_orderkey,
  {sql.r6("z1")} AS o_totalprice, {sql.r6("z2")} AS o_day, {sql.r6("z3")} AS c_acctbal
  FROM normed""")
def zscore(spark, d):
    z = stats.zscore(ord_(spark, d), ORD.numeric_qis)
    return z.select("o_orderkey", *[r6(c).alias(c) for c in ORD.numeric_qis])


@query(sql.with_(sql.ORD, sql.norms("ord", 3))
       + f"SELECT pid AS o_orderkey, {sql.r6('norm')} AS norm FROM normed")
def qi_norm(spark, d):
    rows = stats.qi_norm(ord_(spark, d), ORD.numeric_qis)
    return rows.select("o_orderkey", r6("norm").alias("norm"))


_SHARES = """held AS (
  SELECT l.level, l.path, b.bucket, s.share AS q,
         ((b.freq + l.path) >> l.level) / sum((b.freq + l.path) >> l.level)
           OVER (PARTITION BY l.level, l.path) AS p
  FROM leaves l, buckets b JOIN shares s ON s.bucket = b.bucket)"""


def _bucket_shares(spark, d) -> DataFrame:
    """Share of every bucket in every class (p) and in the table (q)."""
    made = plans.class_plan(
        ord_(spark, d), "n_name", "tclose", CLOSE, paths(spark, d), HEIGHT
    )
    leaves = classes.collect_leaves(made.plan, made.states)
    sizes = classes.bucket_sizes(made.plan)
    total = F.sum("freq").over(Window.partitionBy("threshold"))
    overall = sizes.select("bucket", (F.col("freq") / total).alias("q"))
    here = F.sum("size").over(Window.partitionBy("level", "path"))
    return leaves.withColumn("p", F.col("size") / here).join(overall, "bucket")


@query(sql.with_(*CLOSE_PLAN, sql.tree("emd"), _SHARES) + f"""
SELECT CAST(level AS BIGINT) AS level, path, {sql.r6("sum(abs(run))")} AS emd FROM (
  SELECT level, path, sum(p - q) OVER (PARTITION BY level, path ORDER BY bucket) AS run FROM held)
GROUP BY level, path""")
def emd(spark, d):
    far = stats.emd(_bucket_shares(spark, d), ["level", "path"], "bucket", "p", "q")
    return far.select(lng("level").alias("level"), "path", r6("emd").alias("emd"))


@query(sql.with_(*CLOSE_PLAN, sql.tree("emd"), _SHARES) + f"""
SELECT CAST(level AS BIGINT) AS level, path,
  {sql.r6("CASE WHEN bool_or(q > 0 AND p = 0) THEN CAST('infinity' AS DOUBLE) "
          "ELSE sum(CASE WHEN q > 0 AND p > 0 THEN q * ln(q / p) ELSE 0 END) END")} AS kl
FROM held GROUP BY level, path""")
def kl_divergence(spark, d):
    """The table's shares against those of every class."""
    far = stats.kl_divergence(_bucket_shares(spark, d), ["level", "path"], "q", "p")
    return far.select(lng("level").alias("level"), "path", r6("kl").alias("kl"))


_MEDIAN = """SELECT ec, cat FROM (
  SELECT ec, cat, row_number() OVER (PARTITION BY ec ORDER BY cat) AS rn,
         count(*) OVER (PARTITION BY ec) AS n FROM assigned) WHERE rn = n // 2 + 1"""


@query(sql.with_(*ORD_ASSIGNED) + f"SELECT ec, cat AS o_orderpriority FROM ({_MEDIAN})")
def categorical_median(spark, d):
    return stats.categorical_median(ord_assigned(spark, d), ["o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber, "
       "floor(l_tax * l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS tax "
       "FROM lineitem")
def round_half_up_(spark, d):
    tax = round_half_up(F.col("l_tax") * F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tax.alias("tax"))


# ---------------------------------------------------------- bucketization


def _plan_columns(plan: DataFrame) -> DataFrame:
    return plan.select("bucket", "sa", "quota", "freq", r6("cap").alias("cap"))


_PLAN = f"SELECT bucket, sa, quota, freq, {sql.r6('cap')} AS cap FROM plan"


@query(sql.with_(*sql.beta_plan("ord", sql.ORD, [BETA_WIDE])) + _PLAN)
def beta_buckets(spark, d):
    return _plan_columns(plans.bucket_plan(ord_(spark, d), "n_name", "beta", [BETA_WIDE]))


@query(sql.with_(*OVER_PLAN) + _PLAN)
def overlap_buckets(spark, d):
    return _plan_columns(plans.bucket_plan(
        ord_(spark, d), "n_name", "overlap", [OVERLAP], paths(spark, d), HEIGHT
    ))


@query(sql.with_(*CLOSE_PLAN) + _PLAN)
def tclose_buckets(spark, d):
    return _plan_columns(plans.bucket_plan(
        ord_(spark, d), "n_name", "tclose", [CLOSE], paths(spark, d), HEIGHT
    ))


@query(sql.with_(*OVER_PLAN) + f"SELECT bucket, freq, {sql.r6('cap')} AS cap FROM buckets")
def bucket_dedup(spark, d):
    plan = plans.bucket_plan(
        ord_(spark, d), "n_name", "overlap", [OVERLAP], paths(spark, d), HEIGHT
    )
    return bucketing.bucket_dedup(plan).select("bucket", "freq", r6("cap").alias("cap"))


# ---------------------------------------------------------------- classes


@query(sql.with_(*ORD_PLAN, sql.tree("likeness"))
       + "SELECT CAST(level AS BIGINT) AS level, path, splits FROM verdict")
def split_by_likeness(spark, d):
    plan = plans.bucket_plan(ord_(spark, d), "n_name", "beta", [BETA_ORD])
    return classes.split_tree(plan, "likeness").select(
        lng("level").alias("level"), "path", "splits"
    )


@query(sql.with_(*CLOSE_PLAN, sql.tree("emd"))
       + "SELECT CAST(level AS BIGINT) AS level, path, splits FROM verdict")
def split_by_emd(spark, d):
    plan = plans.bucket_plan(
        ord_(spark, d), "n_name", "tclose", [CLOSE], paths(spark, d), HEIGHT
    )
    return classes.split_tree(plan, "emd").select(lng("level").alias("level"), "path", "splits")


@query(sql.with_(*ORD_PLAN, sql.tree("likeness")) + """
SELECT CAST(l.level AS BIGINT) AS level, l.path, b.bucket, (b.freq + l.path) >> l.level AS size
FROM leaves l, buckets b""")
def collect_leaves(spark, d):
    made = plans.class_plan(ord_(spark, d), "n_name", "beta", BETA_ORD)
    return classes.collect_leaves(made.plan, made.states).select(
        lng("level").alias("level"), "path", "bucket", "size"
    )


# ---------------------------------------------------------- redistribution


@query(sql.with_(*ORD_ASSIGNED) + "SELECT pid AS o_orderkey, bucket, ec FROM assigned")
def redistribute_by_norm(spark, d):
    return ord_assigned(spark, d).select("o_orderkey", "bucket", "ec")


@query(sql.with_(*OVER_PLAN, sql.norms("ord", 3), sql.QUOTA_PLACED)
       + "SELECT pid AS o_orderkey, bucket FROM placed")
def dedup_overlap(spark, d):
    rows = project_roles(ord_(spark, d), ORD)
    plan = plans.bucket_plan(rows, "n_name", "overlap", [OVERLAP], paths(spark, d), HEIGHT)
    scaling = stats.fit_scaling(rows, ORD.numeric_qis)
    keyed = redist.with_norm_key(rows, ORD, scaling)
    return redist.dedup_overlap(
        keyed, ORD, plan, redist.PlanSize.of(plan), scaling.rows, redist.CELL_ROWS
    ).select("o_orderkey", "bucket")


@query(sql.with_(*CLOSE_ASSIGNED) + """
SELECT bucket, ec, count(*) AS rows, min(rn) AS first_rank, max(rn) AS last_rank
FROM assigned GROUP BY bucket, ec""")
def redistribute_contiguous(spark, d):
    """Every class takes one run of consecutive ranks of a bucket."""
    rows = project_roles(ord_(spark, d), ORD)
    made = plans.class_plan(rows, "n_name", "tclose", CLOSE, paths(spark, d), HEIGHT)
    ranked = redist.rank_rows(rows, ORD, made.plan)
    seated = redist.join_seat(ranked, made.runs, 2 * made.levels * made.plan.count())
    return seated.groupBy("bucket", "ec").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("rn").alias("first_rank"),
        F.max("rn").alias("last_rank"),
    )


@query(sql.with_(*sql.beta_plan("cust", sql.CUST, [BETA_WIDE]), sql.tree("likeness"), sql.SEATS) + """
SELECT bucket, (CAST(1 AS BIGINT) << level) + seq AS ec, size AS rows FROM seats""")
def redistribute_by_center(spark, d):
    """Rows per bucket and class: every seat is taken, none twice."""
    made = cust_classes(spark, d, BETA_WIDE)
    seats = classes.rank_seats(made.runs).select(
        (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")) + F.col("seq"))
        .alias("ec"), "bucket", "size",
    )
    rows = project_roles(cust(spark, d), CUST)
    sizes = seats.groupBy("ec").agg(F.sum("size").alias("size"))
    middle = centers.class_centers_kmeans(stats.zscore(rows, CUST.numeric_qis), CUST.numeric_qis, sizes)
    look = made.plan.select(F.col("sa").alias("n_name"), "bucket")
    placed = centers.redistribute_by_center(
        stats.zscore(rows, CUST.numeric_qis).join(look, "n_name"),
        CUST.numeric_qis, "c_custkey", middle, seats,
    )
    return placed.groupBy("bucket", "ec").agg(F.countDistinct("c_custkey").alias("rows"))


@query(sql.with_(*sql.beta_plan("cust", sql.CUST, [BETA_WIDE]), sql.tree("likeness"), sql.SEATS,
                 sql.norms("cust", 1), "pts AS MATERIALIZED (SELECT pid, 0 AS i, z1 AS a FROM zs)",
                 "room AS MATERIALIZED (SELECT bucket, (CAST(1 AS BIGINT) << level) + seq AS ec, size AS room FROM seats)",
                 sql.random_centers("pts", "SELECT count(DISTINCT ec) FROM room"),
                 """class_middle AS MATERIALIZED (SELECT ec, m FROM middle JOIN (
  SELECT ec, row_number() OVER (ORDER BY sum(room) DESC, ec) - 1 AS cluster FROM room GROUP BY ec) USING (cluster)),
waiting AS MATERIALIZED (SELECT z.pid, z.z1, p.bucket FROM zs z JOIN plan p ON p.sa = z.sa)""",
                 sql.MATCHED) + f"""
SELECT pid AS c_custkey, CAST(bucket AS BIGINT) AS bucket, ec, {sql.r6("d")} AS distance FROM matched""")
def match_to_centers(spark, d):
    """Every row with its class: no row and class would rather have each other."""
    made = cust_classes(spark, d, BETA_WIDE)
    seats = class_seats(made)
    rows = project_roles(cust(spark, d), CUST)
    sizes = seats.groupBy("ec").agg(F.sum("size").alias("size"))
    points = stats.zscore(rows, CUST.numeric_qis)
    middle = centers.class_centers_random(points, CUST.numeric_qis, sizes, pid="c_custkey")
    look = made.plan.select(F.col("sa").alias("n_name"), "bucket")
    placed = centers.match_to_centers(
        points.join(look, "n_name"), CUST.numeric_qis, "c_custkey", middle, seats
    ).rows
    return placed.select("c_custkey", lng("bucket").alias("bucket"), "ec", r6("distance").alias("distance"))


# ----------------------------------------------------------------- recoding


def _released(df: DataFrame, roles: Roles) -> DataFrame:
    return df.withColumns({c: r6(c) for c in roles.numeric_qis})


_ORD_MEANS = ", ".join(
    f"{sql.r6(f'avg({q}) OVER (PARTITION BY ec)')} AS {c}"
    for q, c in zip(("q1", "q2", "q3"), ORD.numeric_qis)
)


@query(sql.with_(*ORD_ASSIGNED) + f"SELECT pid AS o_orderkey, {_ORD_MEANS}, "
       "cat AS o_orderpriority, sa AS n_name FROM assigned")
def recode_mean(spark, d):
    made, rows = ord_made(spark, d)
    return _released(recode.recode_mean(rows, ORD, keep_pid=True, classes=made.classes), ORD)


@query(sql.with_(*ORD_ASSIGNED) + f"SELECT pid AS o_orderkey, {_ORD_MEANS}, "
       "min(cat) OVER (PARTITION BY ec) || '-' || max(cat) OVER (PARTITION BY ec) "
       "AS o_orderpriority, sa AS n_name FROM assigned")
def recode_minmax(spark, d):
    made, rows = ord_made(spark, d)
    return _released(recode.recode_minmax(rows, ORD, keep_pid=True, classes=made.classes), ORD)


@query(sql.with_(*ORD_ASSIGNED, f"mid AS ({_MEDIAN})") + f"""
SELECT pid AS o_orderkey, {_ORD_MEANS.replace("BY ec", "BY a.ec")},
       m.cat AS o_orderpriority, sa AS n_name FROM assigned a JOIN mid m ON m.ec = a.ec""")
def recode_median(spark, d):
    made, rows = ord_made(spark, d)
    return _released(recode.recode_median(rows, ORD, keep_pid=True, classes=made.classes), ORD)


# ----------------------------------------------------------------- Mondrian


@query(sql.with_(*ORD_MONDRIAN) + f"""SELECT pid AS o_orderkey, {sql.r6("z1")} AS o_totalprice,
  {sql.r6("z2")} AS o_day, {sql.r6("z3")} AS c_acctbal FROM mz""")
def mondrian_normalize(spark, d):
    z = mondrian.mondrian_normalize(ord_(spark, d), ORD)
    return z.select("o_orderkey", *[r6(c).alias(c) for c in ORD.numeric_qis])


@query(sql.with_(*ORD_MONDRIAN) + "SELECT pid AS o_orderkey, ec FROM grouped")
def mondrian_partition(spark, d):
    return mondrian.mondrian_partition(ord_(spark, d), ORD, K).select("o_orderkey", "ec")


_MONDRIAN_RELEASE = (
    sql.with_(*ORD_MONDRIAN) + f"SELECT ec, pid AS o_orderkey, {_ORD_MEANS}, "
    "sa AS n_name FROM grouped"
)


@query(_MONDRIAN_RELEASE)
def mondrian_release(spark, d):
    made = mondrian.mondrian_partition(ord_(spark, d), ORD, K)
    return _released(mondrian.mondrian_release(made, ORD, keep_pid=True), ORD)


# ------------------------------------------------------------------ ranking


@query(sql.with_(*ORD_ASSIGNED) + "SELECT pid AS o_orderkey, bucket, rn FROM ranked")
def rank_rows(spark, d):
    rows = project_roles(ord_(spark, d), ORD)
    plan = plans.bucket_plan(rows, "n_name", "beta", [BETA_ORD])
    return redist.rank_rows(rows, ORD, plan).select("o_orderkey", "bucket", "rn")


@query(sql.with_(*ORD_PLAN, sql.tree("likeness"), sql.SEATS)
       + "SELECT bucket, CAST(level AS BIGINT) AS level, seq, size, first_seat FROM seats")
def rank_seats(spark, d):
    made = plans.class_plan(ord_(spark, d), "n_name", "beta", BETA_ORD)
    return classes.rank_seats(made.runs).select(
        "bucket", lng("level").alias("level"), "seq", "size", "first_seat"
    )


_WIDE_K = 500


@query(sql.with_(sql.ORD, sql.mondrian("ord", 3, _WIDE_K)) + """
SELECT pid AS o_orderkey, ec, row_number() OVER (PARTITION BY ec ORDER BY v, tie) AS rn FROM (
  SELECT *, CASE WHEN r1 >= r2 AND r1 >= r3 THEN z1 WHEN r2 >= r3 THEN z2 ELSE z3 END AS v FROM (
    SELECT *, max(z1) OVER w - min(z1) OVER w AS r1, max(z2) OVER w - min(z2) OVER w AS r2,
           max(z3) OVER w - min(z3) OVER w AS r3 FROM grouped WINDOW w AS (PARTITION BY ec)))""")
def rank_in_partition(spark, d):
    rows = ord_(spark, d)
    groups = mondrian.mondrian_partition(rows, ORD, _WIDE_K)
    scaling = stats.fit_scaling(rows, ORD.numeric_qis, sample=True)
    scaled = mondrian.mondrian_normalize(groups, ORD, scaling)
    return mondrian.rank_in_partition(scaled, ORD, "ec", scaling.rows).select(
        "o_orderkey", "ec", "rn"
    )


@query(sql.with_(sql.ORD, sql.hist("ord"), sql.thresholds([BETA_WIDE]), sql.CAPS) + f"""
SELECT sa, freq, {sql.r6("cap")} AS cap, row_number() OVER (ORDER BY freq, sa) AS position
FROM caps""")
def sort_by_cap(spark, d):
    histogram = stats.sa_histogram(ord_(spark, d), "n_name")
    return bucketing.sort_by_cap(histogram, BETA_WIDE).withColumn("cap", r6("cap"))


def _skew(level_sa: str) -> str:
    return f"""cnt AS (SELECT ec, {level_sa} AS value, count(*) AS n FROM assigned GROUP BY 1, 2),
skew AS (
  SELECT ec, value, abs(p_table - p_class) / p_table * 100 AS change, p_table, p_class FROM (
    SELECT ec, value, n / sum(n) OVER (PARTITION BY ec) AS p_class,
           sum(n) OVER (PARTITION BY value) / sum(n) OVER () AS p_table FROM cnt))"""


@query(sql.with_(*CUST_ASSIGNED, _skew("sa")) + f"""
SELECT ec, value, {sql.r6("change")} AS change FROM (
  SELECT *, row_number() OVER (ORDER BY floor(change * 1e6 + 0.51) DESC, ec, value) AS rn FROM skew)
WHERE rn = 1""")
def worst_class(spark, d):
    counts = audit.class_value_counts(cust_assigned(spark, d), "n_name")
    skew = audit.skew_per_sa(counts).withColumn("change", r6("change"))
    return audit.worst_class(skew).select("ec", "value", "change")


@query(sql.with_(*EVT_ASSIGNED) + "SELECT ec, count(*) AS size FROM assigned GROUP BY ec "
       "ORDER BY size DESC, ec")
def classes_by_size(spark, d):
    """Classes of the events: a sensitive value without a tree."""
    return audit.classes_by_size(evt_assigned(spark, d, BETA_CUST))


# ----------------------------------------------------------- set operations


@query(sql.with_(*CLOSE_PLAN, sql.tree("emd"))
       + "SELECT CAST(level AS BIGINT) AS level, path FROM leaves")
def union_leaves(spark, d):
    made = plans.class_plan(
        ord_(spark, d), "n_name", "tclose", CLOSE, paths(spark, d), HEIGHT
    )
    return classes.expand_nodes(made.states).select(lng("level").alias("level"), "path")


@query("SELECT DISTINCT l_orderkey FROM lineitem")
def distinct_ids(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey").dropDuplicates(["l_orderkey"])


@query(sql.with_(*CLOSE_PLAN, sql.tree("emd")) + """
SELECT CAST(level AS BIGINT) AS level, count(*) FILTER (WHERE splits) AS open_nodes,
       count(*) FILTER (WHERE NOT splits) AS complete_nodes FROM verdict GROUP BY level""")
def split_frontier(spark, d):
    """Open and complete nodes of every level, counted from the states."""
    made = plans.class_plan(
        ord_(spark, d), "n_name", "tclose", CLOSE, paths(spark, d), HEIGHT
    )
    nodes = F.col("nodes")
    return made.states.groupBy(lng("level").alias("level")).agg(
        F.coalesce(F.sum(F.when(F.col("splits"), nodes)), F.lit(0)).alias("open_nodes"),
        F.coalesce(F.sum(F.when(~F.col("splits"), nodes)), F.lit(0)).alias("complete_nodes"),
    )


# ------------------------------------------------------------------- audits

_LOSS = """loss AS (
  SELECT ec, count(*) AS size, max(q1) - min(q1) AS d1, max(q2) - min(q2) AS d2,
         max(q3) - min(q3) AS d3 FROM assigned GROUP BY ec),
span AS (SELECT max(q1) - min(q1) AS g1, max(q2) - min(q2) AS g2, max(q3) - min(q3) AS g3,
                count(*) AS n FROM assigned)"""


@query(sql.with_(*ORD_ASSIGNED, _LOSS) + """
SELECT floor(sum((d1 / g1 + d2 / g2 + d3 / g3) * size) * 1e3 + 0.51) / 1e3 AS information_loss,
       floor(sum((d1 / g1 + d2 / g2 + d3 / g3) * size) / (max(n) * 3) * 1e6 + 0.51) / 1e6
         AS normalized
FROM loss, span""")
def information_loss(spark, d):
    loss = audit.information_loss(ord_assigned(spark, d), ORD.numeric_qis)
    return loss.select(
        (F.floor(F.col("information_loss") * 1e3 + 0.51).cast("double") / 1e3).alias(
            "information_loss"
        ),
        r6("normalized").alias("normalized"),
    )


@query(sql.with_(*ORD_ASSIGNED, _LOSS) + f"""SELECT ec, size, {sql.r6("d1")} AS price_range,
  {sql.r6("d2")} AS day_range, {sql.r6("d3")} AS balance_range FROM loss""")
def ec_range_report(spark, d):
    report = audit.ec_range_report(ord_assigned(spark, d), ORD.numeric_qis)
    return report.select(
        "ec",
        "size",
        r6("o_totalprice_range").alias("price_range"),
        r6("o_day_range").alias("day_range"),
        r6("c_acctbal_range").alias("balance_range"),
    )


def _ord_skew(spark, d, level=HEIGHT):
    counts = audit.class_value_counts(
        ord_assigned(spark, d), "n_name", paths(spark, d), level, HEIGHT
    )
    return audit.skew_per_sa(counts)


@query(sql.with_(*ORD_ASSIGNED, _skew("region"))
       + f"SELECT ec, value, {sql.r6('change')} AS change FROM skew")
def skew_per_sa(spark, d):
    """Skewness one level above the values."""
    return _ord_skew(spark, d, 1).select("ec", "value", r6("change").alias("change"))


@query(sql.with_(*ORD_ASSIGNED, _skew("'ALL'"))
       + f"SELECT ec, value, {sql.r6('change')} AS change FROM skew")
def skew_per_sa_top(spark, d):
    """Skewness at the top of the tree, where every share is 1."""
    return _ord_skew(spark, d, 0).select("ec", "value", r6("change").alias("change"))


@query(sql.with_(*ORD_ASSIGNED, _skew("sa")) + f"""SELECT ec, {sql.r6("avg(change)")} AS avg_change,
  {sql.r6("max(change)")} AS max_change FROM skew GROUP BY ec""")
def skew_per_ec(spark, d):
    per_ec = audit.skew_per_ec(_ord_skew(spark, d))
    return per_ec.select("ec", r6("avg_change").alias("avg_change"),
                         r6("max_change").alias("max_change"))


@query(sql.with_(*ORD_ASSIGNED, _skew("sa")) + f"""SELECT {sql.r6("avg(a)")} AS avg_change,
  {sql.r6("max(m)")} AS max_change, count(*) AS classes FROM (
  SELECT ec, avg(change) AS a, max(change) AS m FROM skew GROUP BY ec)""")
def skew_dataset(spark, d):
    all_ = audit.skew_dataset(audit.skew_per_ec(_ord_skew(spark, d)))
    return all_.select(r6("avg_change").alias("avg_change"), r6("max_change").alias("max_change"),
                       "classes")


@query(sql.with_(*ORD_ASSIGNED, sql.hist("assigned").replace("hist AS", "ahist AS"), """
full_grid AS (
  SELECT e.ec, h.sa, coalesce(c.n, 0) / e.n - h.p AS diff
  FROM (SELECT ec, count(*) AS n FROM assigned GROUP BY ec) e CROSS JOIN ahist h
  LEFT JOIN (SELECT ec, sa, count(*) AS n FROM assigned GROUP BY ec, sa) c
    ON c.ec = e.ec AND c.sa = h.sa)""") + f"""
SELECT ec, {sql.r6("sum(abs(run))")} AS emd FROM (
  SELECT ec, sum(diff) OVER (PARTITION BY ec ORDER BY sa) AS run FROM full_grid) GROUP BY ec""")
def emd_per_class(spark, d):
    counts = audit.class_value_counts(ord_assigned(spark, d), "n_name")
    return audit.emd_per_class(counts).withColumn("emd", r6("emd"))


@query(sql.with_(*ORD_ASSIGNED) + "SELECT ec, count(*) AS size FROM assigned GROUP BY ec")
def ec_sizes_bucketed(spark, d):
    """Class sizes from an assigned table in buckets of ``ec``, without a shuffle."""
    name = scratch_path(spark, "assigned").rsplit("/", 1)[1].replace("-", "_")
    kept = microdata.write_assigned_table(ord_assigned(spark, d), name, 8)
    sizes = materialize(stats.ec_sizes(kept), "sizes")
    microdata.drop_assigned_table(spark, name)
    return sizes.select("ec", lng("size").alias("size"))


# ------------------------------------------------------------------ centres

@query(sql.with_(*sql.beta_plan("ord", sql.ORD, [BETA_WIDE]), sql.tree("likeness"), sql.SEATS) + """
SELECT ec, size, CAST(row_number() OVER (ORDER BY size DESC, ec) - 1 AS BIGINT) AS cluster FROM (
  SELECT (CAST(1 AS BIGINT) << level) + seq AS ec, CAST(sum(size) AS BIGINT) AS size
  FROM seats GROUP BY level, seq)""")
def class_centers_kmeans(spark, d):
    """Which class got which cluster; the centres depend on the seed."""
    rows = project_roles(ord_(spark, d), ORD)
    sizes = plans.class_plan(rows, "n_name", "beta", BETA_WIDE)
    seats = classes.rank_seats(sizes.runs).groupBy(
        (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")) + F.col("seq"))
        .alias("ec")
    ).agg(F.sum("size").alias("size"))
    made = centers.class_centers_kmeans(stats.zscore(rows, ORD.numeric_qis), ORD.numeric_qis, seats)
    return made.select("ec", "size", lng("cluster").alias("cluster"))


def _long(made: DataFrame, names: list[str]) -> DataFrame:
    """Centres with one row per coordinate."""
    each = F.posexplode(F.array(*names)).alias("element", "value")
    return made.select("ec", "size", lng("cluster").alias("cluster"), each).select(
        "ec", "size", "cluster", lng("element").alias("element"), r6("value").alias("value")
    )


@query()
def class_centers_kmeans_rows(spark, d):
    """The centres themselves, seeded in coarse cells."""
    rows = project_roles(ord_(spark, d), ORD)
    sizes = plans.class_plan(rows, "n_name", "beta", BETA_WIDE)
    seats = class_seats(sizes).groupBy("ec").agg(F.sum("size").alias("size"))
    made = centers.class_centers_kmeans(
        stats.zscore(rows, ORD.numeric_qis), ORD.numeric_qis, seats, pid="o_orderkey"
    )
    return _long(made, ORD.numeric_qis)


@query(sql.with_("""e AS (SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pts AS MATERIALIZED (SELECT pid, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS a FROM e)""",
                 sql.random_centers("pts", "SELECT count(DISTINCT label) FROM embeddings"),
                 """sized AS (SELECT label, size, row_number() OVER (ORDER BY size DESC, label) - 1 AS cluster
  FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY label))""") + f"""
SELECT CAST(label AS BIGINT) AS ec, size, CAST(cluster AS BIGINT) AS cluster, CAST(i AS BIGINT) AS element,
  {sql.r6("m")} AS value FROM sized JOIN middle USING (cluster)""")
def class_centers_random(spark, d):
    """One k-means step from drawn rows, and which class got which cluster."""
    rows, names = emb(spark, d)
    sizes = rows.groupBy(F.col("label").alias("ec")).agg(F.count(F.lit(1)).alias("size"))
    return _long(centers.class_centers_random(rows, names, sizes, pid="vec_id"), names)


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS a FROM e),
c AS (SELECT label AS center, list(m ORDER BY i) AS m FROM (
  SELECT label, i, avg(a) AS m FROM x GROUP BY label, i) GROUP BY label),
far AS (SELECT vec_id, center, list_sum(list_transform(range(1, len(v) + 1),
  lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS dist FROM e, c)
SELECT vec_id, CAST(center AS BIGINT) AS center, """ + sql.r6("dist") + """ AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, center) AS rn FROM far)
WHERE rn = 1""")
def nearest_center(spark, d):
    rows, names = emb(spark, d)
    middle = rows.groupBy(F.col("label").alias("center")).agg(*[F.avg(c).alias(c) for c in names])
    near = centers.nearest_center(rows, names, middle)
    return near.select("vec_id", "center", r6("distance").alias("distance"))


@query(sql.with_(sql.CUST, sql.norms("cust", 1), "pts AS MATERIALIZED (SELECT pid, z1 AS z, cat FROM zs)",
                 sql.mixed_seeds(8)) + f"""
SELECT pid AS c_custkey, {sql.r6("z")} AS c_acctbal, cat AS c_mktsegment, weight, pick FROM picked""")
def seed_centers_mixed(spark, d):
    rows = stats.zscore(project_roles(cust(spark, d), CUST), CUST.numeric_qis)
    tree = taxonomy.ancestor_paths(segment_edges(spark, d), 1)
    seeds = centers.seed_centers_mixed(
        rows, CUST.numeric_qis, [("c_mktsegment", 1)], tree, "c_custkey", 8
    )
    return seeds.withColumn("c_acctbal", r6("c_acctbal"))


# ---------------------------------------------------------------- pipelines


@query(_RELEASE)
def anonymize_beta(spark, d):
    """Flagship: buckets, classes, redistribution and recoding of customers."""
    released = plans.anonymize(cust(spark, d), CUST, "beta", BETA_CUST)
    return released.withColumn("c_acctbal", r6("c_acctbal"))


_ORD_RELEASE = f"SELECT pid AS o_orderkey, {_ORD_MEANS}, cat AS o_orderpriority, sa AS n_name "


@query(sql.with_(*OVER_ASSIGNED) + _ORD_RELEASE + "FROM assigned")
def anonymize_overlap(spark, d):
    tree = taxonomy.validate_taxonomy(edges(spark, d), HEIGHT)
    return _released(plans.anonymize(
        ord_(spark, d), ORD, "overlap", OVERLAP, tree, HEIGHT, keep_pid=True
    ), ORD)


@query(sql.with_(*CLOSE_ASSIGNED) + _ORD_RELEASE + "FROM assigned")
def anonymize_tclose(spark, d):
    tree = taxonomy.validate_taxonomy(edges(spark, d), HEIGHT)
    return _released(plans.anonymize(
        ord_(spark, d), ORD, "tclose", CLOSE, tree, HEIGHT, keep_pid=True
    ), ORD)


@query(_MONDRIAN_RELEASE)
def anonymize_mondrian(spark, d):
    return _released(plans.anonymize_mondrian(ord_(spark, d), ORD, K, keep_pid=True), ORD)


_SWEEP = [0.0 + i * 0.25 for i in range(1, 13)]


@query(sql.with_(*sql.beta_plan("ord", sql.ORD, _SWEEP), sql.tree("likeness")) + """
SELECT threshold, b AS buckets, c AS classes FROM
  (SELECT threshold, count(*) AS b FROM buckets GROUP BY threshold) JOIN
  (SELECT threshold, count(*) AS c FROM leaves GROUP BY threshold) USING (threshold)""")
def threshold_sweep(spark, d):
    swept = plans.threshold_sweep(ord_(spark, d), "n_name", "beta", 0.0, 3.0, 0.25)
    return swept.select("threshold", "buckets", "classes")


_SWEPT = """
SELECT threshold, b AS buckets, c AS classes FROM
  (SELECT threshold, count(*) AS b FROM buckets GROUP BY threshold) JOIN
  (SELECT threshold, count(*) AS c FROM leaves GROUP BY threshold) USING (threshold)"""
_SWEEP_FEW = [0.0 + i * 1.0 for i in range(1, 4)]
_SWEEP_CLOSE = [0.0 + i * 0.25 for i in range(1, 5)]


@query(sql.with_(*sql.overlap_plan("ord", sql.ORD, _SWEEP_FEW), sql.tree("likeness")) + _SWEPT)
def threshold_sweep_overlap(spark, d):
    swept = plans.threshold_sweep(
        ord_(spark, d), "n_name", "overlap", 0.0, 3.0, 1.0, paths(spark, d), HEIGHT
    )
    return swept.select("threshold", "buckets", "classes")


@query(sql.with_(*sql.tclose_plan("ord", sql.ORD, _SWEEP_CLOSE), sql.tree("emd")) + _SWEPT)
def threshold_sweep_tclose(spark, d):
    swept = plans.threshold_sweep(
        ord_(spark, d), "n_name", "tclose", 0.0, 1.0, 0.25, paths(spark, d), HEIGHT
    )
    return swept.select("threshold", "buckets", "classes")


# -------------------------------------------------- the ways of large tables

#: Rows of a rank cell and of a local group that bring small tables to the ways of
#: large ones.
_CELL, _LOCAL = 500, 400


@query(sql.with_(*OVER_ASSIGNED) + _ORD_RELEASE + "FROM assigned")
def anonymize_overlap_cells(spark, d):
    """As ``anonymize_overlap``, ranked in cells."""
    tree = taxonomy.validate_taxonomy(edges(spark, d), HEIGHT)
    return _released(plans.anonymize(
        ord_(spark, d), ORD, "overlap", OVERLAP, tree, HEIGHT, keep_pid=True,
        cell_rows=max(_CELL, table(spark, d, "orders").count() // 20),
    ), ORD)


@query(_MONDRIAN_RELEASE)
def anonymize_mondrian_bins(spark, d):
    """As ``anonymize_mondrian``, split by counting in bins first."""
    return _released(plans.anonymize_mondrian(
        ord_(spark, d), ORD, K, keep_pid=True, exact_rows=_LOCAL,
        local_rows=max(_LOCAL, table(spark, d, "orders").count() // 20),
    ), ORD)


@query(sql.with_(*ORD_ASSIGNED) + f"SELECT pid AS o_orderkey, {_ORD_MEANS}, "
       "cat AS o_orderpriority, sa AS n_name FROM assigned")
def recode_mean_two_sided(spark, d):
    """As ``recode_mean`` without the number of classes: large and small ones apart."""
    return _released(recode.recode_mean(ord_assigned(spark, d), ORD, keep_pid=True), ORD)
