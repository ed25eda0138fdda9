"""SQL for DuckDB: the same results from definitions, row by row."""

from __future__ import annotations

CUST = """cust AS (
  SELECT c_custkey AS pid, c_acctbal AS q1, c_mktsegment AS cat, n_name AS sa, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

ORD = """ord AS (
  SELECT o_orderkey AS pid, o_totalprice AS q1,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS q2,
         c_acctbal AS q3, o_orderpriority AS cat, n_name AS sa, r_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EVT = """evt AS (
  SELECT event_id AS pid, value AS q1,
         CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60
              + floor(extract(second FROM ts)) AS DOUBLE) AS q2,
         CAST(user_id AS DOUBLE) AS q3, event_type AS sa
  FROM events)"""

EDGES = """edges AS (
  SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT r_name, 'ALL' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'ALL', '*' UNION SELECT '*', '*')"""

CLOSURE = """closure AS (
  SELECT child AS node, child AS ancestor, CAST(0 AS BIGINT) AS height FROM edges
  UNION ALL
  SELECT c.node, e.parent, c.height + 1 FROM closure c JOIN edges e ON e.child = c.ancestor
  WHERE c.ancestor <> '*')"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def r6(expr: str) -> str:
    """Six digits for comparison; means of amounts in cents often end in an
    exact half, and 0.51 keeps those away from the rounding edge."""
    return f"(floor(({expr}) * 1e6::DOUBLE + 0.51::DOUBLE) / 1e6::DOUBLE)"


def thresholds(values) -> str:
    listed = ", ".join(repr(float(v)) + "::DOUBLE" for v in values)
    return f"thr AS (SELECT unnest([{listed}]) AS threshold)"


def hist(src: str) -> str:
    return f"""hist AS (
  SELECT sa, freq, CAST(sum(freq) OVER () AS BIGINT) AS total,
         CAST(freq AS DOUBLE) / CAST(sum(freq) OVER () AS BIGINT) AS p
  FROM (SELECT sa, count(*) AS freq FROM {src} GROUP BY sa))"""


CAPS = """caps AS (
  SELECT threshold, sa, freq, total, p, (1.0 + least(threshold, -ln(p))) * p AS cap
  FROM hist, thr)"""

BETA = """items AS (
  SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY freq, sa) AS i FROM caps),
fold AS (
  SELECT threshold, i, 1 AS b, p AS ps, cap AS bcap FROM items WHERE i = 1
  UNION ALL
  SELECT f.threshold, n.i,
         CASE WHEN f.ps + n.p > least(f.bcap, n.cap) THEN f.b + 1 ELSE f.b END,
         CASE WHEN f.ps + n.p > least(f.bcap, n.cap) THEN n.p ELSE f.ps + n.p END,
         CASE WHEN f.ps + n.p > least(f.bcap, n.cap) THEN n.cap ELSE least(f.bcap, n.cap) END
  FROM fold f JOIN items n ON n.threshold = f.threshold AND n.i = f.i + 1),
groups AS (
  SELECT threshold, b, list(sa ORDER BY sa) AS names, CAST(sum(freq) AS BIGINT) AS freq,
         min(bcap) AS cap
  FROM fold JOIN items USING (threshold, i) GROUP BY threshold, b),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY names, freq) AS bucket
  FROM groups),
plan AS (
  SELECT f.threshold, n.bucket, i.sa, i.freq AS quota, n.freq, n.cap
  FROM fold f JOIN items i USING (threshold, i) JOIN numbered n USING (threshold, b))"""


def tcost(height: int = 2) -> str:
    return f"""place AS (
  SELECT h.sa, h.p, l.level, a.ancestor AS node, b.ancestor AS below
  FROM hist h, (SELECT unnest(range(0, {height} + 1)) AS level) l
  JOIN closure a ON a.node = h.sa AND a.height = greatest(l.level, 1)
  JOIN closure b ON b.node = h.sa AND b.height = greatest(l.level - 1, 1)),
cost AS (
  SELECT level, node, sum(CAST(level AS DOUBLE) / {float(height)} * (s - m)) AS cost
  FROM (SELECT level, node, below, sum(p) AS s, min(p) AS m FROM place
        GROUP BY level, node, below)
  GROUP BY level, node),
sacost AS (
  SELECT p.sa, p.level, p.node, c.cost FROM place p
  JOIN cost c ON c.level = p.level AND c.node = p.node)"""


TCLOSE = """chosen AS (
  SELECT threshold, sa, max(level) AS level FROM sacost, thr WHERE cost < threshold
  GROUP BY threshold, sa),
picked AS (
  SELECT c.threshold, c.sa, c.level, s.node, s.cost, h.freq
  FROM chosen c JOIN sacost s ON s.sa = c.sa AND s.level = c.level JOIN hist h ON h.sa = c.sa),
groups AS (
  SELECT threshold, level, node, list(sa ORDER BY sa) AS names, CAST(sum(freq) AS BIGINT) AS freq,
         max(cost) AS cap
  FROM picked GROUP BY threshold, level, node),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY names, freq) AS bucket
  FROM groups),
plan AS (
  SELECT p.threshold, n.bucket, p.sa, p.freq AS quota, n.freq, n.cap
  FROM picked p JOIN numbered n USING (threshold, level, node))"""

BUCKETS = """buckets AS (
  SELECT threshold, bucket, max(freq) AS freq, max(cap) AS cap FROM plan
  GROUP BY threshold, bucket)"""

_SIDES = "(SELECT unnest([0, 1]) AS side)"


def tree(rule: str) -> str:
    """Nodes of the halving; a node is a leaf if it has no child."""
    if rule == "likeness":
        good = """bool_and(total > 0 AND floor(size / greatest(total, 1) * 100 + 0.5)
                  <= floor(cap * 100 + 0.5))"""
        extra = "cap"
    else:
        good = "bool_and(total > 0) AND max(u) + sum(abs(run)) <= max(threshold)"
        extra = """u, sum(size / greatest(total, 1) - share)
                   OVER (PARTITION BY threshold, path, side ORDER BY bucket) AS run"""
    return f"""shares AS (
  SELECT threshold, bucket, freq, cap,
         CAST(freq AS DOUBLE) / sum(freq) OVER (PARTITION BY threshold) AS share,
         sum(cap) OVER (PARTITION BY threshold) AS u
  FROM buckets),
nodes AS (
  SELECT DISTINCT threshold, 0 AS level, CAST(0 AS BIGINT) AS path FROM buckets
  UNION ALL
  SELECT threshold, level + 1, path + s.side * (CAST(1 AS BIGINT) << level)
  FROM (
    SELECT threshold, level, path FROM (
      SELECT threshold, level, path, side, {good} AS good FROM (
        SELECT threshold, level, path, side, bucket, size, total, {extra} FROM (
          SELECT *, sum(size) OVER (PARTITION BY threshold, path, side) AS total FROM (
            SELECT n.threshold, n.level, n.path, d.side, b.bucket, b.cap, b.share, b.u,
                   (b.freq + n.path + d.side * (CAST(1 AS BIGINT) << n.level))
                     >> (n.level + 1) AS size
            FROM nodes n JOIN shares b ON b.threshold = n.threshold, {_SIDES} d)))
      GROUP BY threshold, level, path, side)
    GROUP BY threshold, level, path HAVING bool_and(good)) k, {_SIDES} s),
verdict AS (
  SELECT n.threshold, n.level, n.path, c.path IS NOT NULL AS splits
  FROM nodes n LEFT JOIN nodes c
    ON c.threshold = n.threshold AND c.level = n.level + 1 AND c.path = n.path),
leaves AS (
  SELECT threshold, level, path,
         row_number() OVER (PARTITION BY threshold, level ORDER BY path) - 1 AS seq
  FROM verdict WHERE NOT splits)"""


SEATS = """seats AS (
  SELECT *, CAST(coalesce(sum(size) OVER (
      PARTITION BY threshold, bucket ORDER BY size DESC, level, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_seat
  FROM (SELECT l.threshold, b.bucket, l.level, l.seq, (b.freq + l.path) >> l.level AS size
        FROM leaves l JOIN buckets b ON b.threshold = l.threshold)
  WHERE size > 0)"""


def norms(src: str, dims: int) -> str:
    cols = [f"q{i + 1}" for i in range(dims)]
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN min({c}) = max({c}) THEN 0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in cols
    )
    z = [f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END" for c in cols]
    zs = ", ".join(f"{e} AS z{i + 1}" for i, e in enumerate(z))
    squares = " + ".join(f"z{i + 1} * z{i + 1}" for i in range(dims))
    return f"""qstats AS (SELECT {stats} FROM {src}),
zs AS (SELECT t.*, {zs} FROM {src} t, qstats),
normed AS (
  SELECT *, sqrt({squares}) AS norm,
         CAST(floor(sqrt({squares}) * 1e9 + 0.5) AS BIGINT) AS nkey,
         md5(CAST(pid AS VARCHAR)) AS tie
  FROM zs)"""


PLACED = """placed AS (
  SELECT n.*, p.bucket FROM normed n JOIN plan p ON p.sa = n.sa)"""

QUOTA_PLACED = """quotas AS (
  SELECT bucket, sa, hi - quota AS lo, hi FROM (
    SELECT *, sum(quota) OVER (PARTITION BY sa ORDER BY bucket) AS hi FROM plan)),
placed AS (
  SELECT n.*, q.bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY sa ORDER BY nkey, tie) AS srank FROM normed) n
  JOIN quotas q ON q.sa = n.sa AND n.srank > q.lo AND n.srank <= q.hi)"""

ASSIGNED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY nkey, tie) AS rn FROM placed),
assigned AS (
  SELECT r.*, s.level, s.seq, (CAST(1 AS BIGINT) << s.level) + s.seq AS ec
  FROM ranked r JOIN seats s
    ON s.bucket = r.bucket AND r.rn >= s.first_seat AND r.rn < s.first_seat + s.size)"""


# Overlapping buckets: one fold per taxonomy level, over the items of a node in
# (cap, names) order. An item is a list of {sa, n}; `held` is the open bucket.

_PREFIX = "coalesce(list_sum(list_transform({l}[1:i - 1], lambda w: w.n)), 0)"


def _take(lst: str, room: str) -> str:
    before = _PREFIX.format(l=lst)
    return (
        f"list_filter(list_transform({lst}, lambda v, i: {{'sa': v.sa, "
        f"'n': CAST(greatest(0, least(v.n, {room} - {before})) AS BIGINT)}}), lambda w: w.n > 0)"
    )


def _rest(lst: str, room: str) -> str:
    before = _PREFIX.format(l=lst)
    return (
        f"list_filter(list_transform({lst}, lambda v, i: {{'sa': v.sa, "
        f"'n': CAST(v.n - greatest(0, least(v.n, {room} - {before})) AS BIGINT)}}), lambda w: w.n > 0)"
    )


def _cap(n: str) -> str:
    return (
        f"(CASE WHEN {n} > 0 THEN (1.0 + least(threshold, -ln(CAST({n} AS DOUBLE) / total)))"
        f" * (CAST({n} AS DOUBLE) / total) ELSE 0 END)"
    )


def _round(level: int, source: str) -> str:
    """Items of `source` (threshold, total, vals, cap) merged under their nodes."""
    r = f"o{level}"
    return f"""{r}_in AS (
  SELECT s.threshold, s.total, c.ancestor AS node, s.vals, s.cap,
         CAST(list_sum(list_transform(s.vals, lambda w: w.n)) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY s.threshold, c.ancestor
           ORDER BY s.cap, list_transform(s.vals, lambda w: w.sa)) AS i,
         count(*) OVER (PARTITION BY s.threshold, c.ancestor) AS items
  FROM {source} s JOIN closure c ON c.node = s.vals[1].sa AND c.height = {level}),
{r}_fold AS (
  SELECT threshold, total, node, items, CAST(0 AS BIGINT) AS i,
         CAST([] AS STRUCT(sa VARCHAR, n BIGINT)[]) AS held, CAST(0 AS BIGINT) AS hsize,
         CAST(0 AS DOUBLE) AS share, CAST('infinity' AS DOUBLE) AS cap,
         CAST([] AS STRUCT(sa VARCHAR, n BIGINT)[]) AS emit, CAST(0 AS DOUBLE) AS emit_cap
  FROM {r}_in WHERE i = 1
  UNION ALL
  SELECT threshold, total, node, items, i,
         CASE WHEN full_ THEN rest ELSE list_concat(held, vals) END,
         CASE WHEN full_ THEN size - room ELSE hsize + size END,
         CASE WHEN full_ THEN CAST(size - room AS DOUBLE) / total ELSE nshare END,
         CASE WHEN full_ AND size = room THEN CAST('infinity' AS DOUBLE)
              WHEN full_ AND (room = 0 OR len(rest) > 1)
                THEN least(ccap, {_cap("(size - room)")})
              WHEN full_ THEN {_cap("(size - room)")}
              ELSE least(ncap, {_cap("size")}) END,
         CASE WHEN full_ THEN list_concat(held, taken)
              ELSE CAST([] AS STRUCT(sa VARCHAR, n BIGINT)[]) END,
         ncap
  FROM (
    SELECT *, {_rest("vals", "room")} AS rest, {_take("vals", "room")} AS taken FROM (
      SELECT *, CASE WHEN free > 0 AND {_cap("free")} < ncap THEN 0 ELSE free END AS room FROM (
        SELECT *, CASE WHEN full_
               THEN greatest(0, least(size, CAST(floor(ncap * total) AS BIGINT) - hsize))
               ELSE 0 END AS free FROM (
          SELECT f.threshold, f.total, f.node, f.items, n.i, f.held, f.hsize, n.vals, n.size,
                 n.cap AS ccap, least(f.cap, n.cap) AS ncap,
                 f.share + CAST(n.size AS DOUBLE) / f.total AS nshare,
                 f.share + CAST(n.size AS DOUBLE) / f.total > least(f.cap, n.cap) AS full_
          FROM {r}_fold f JOIN {r}_in n
            ON n.threshold = f.threshold AND n.node = f.node AND n.i = f.i + 1)))) z),
{r}_made AS (
  SELECT threshold, total, emit AS raw, emit_cap AS cap FROM {r}_fold WHERE len(emit) > 0
  UNION ALL
  SELECT threshold, total, held, cap FROM {r}_fold WHERE i = items AND len(held) > 0),
{r}_sum AS (
  SELECT threshold, total, cap, k, u.sa AS sa, CAST(sum(u.n) AS BIGINT) AS n
  FROM (SELECT threshold, total, cap, k, unnest(raw) AS u FROM (
    SELECT *, row_number() OVER () AS k FROM {r}_made))
  GROUP BY threshold, total, cap, k, u.sa),
{r}_out AS (
  SELECT threshold, total, cap, list({{'sa': sa, 'n': n}} ORDER BY sa) AS vals,
         CAST(sum(n) AS BIGINT) AS freq
  FROM {r}_sum GROUP BY threshold, total, cap, k),
{r}_open AS (SELECT * FROM {r}_out WHERE freq <> CAST(floor(cap * total) AS BIGINT)),
{r}_done AS (SELECT * FROM {r}_out WHERE freq = CAST(floor(cap * total) AS BIGINT))"""


OVERLAP = (
    "o0_open AS (SELECT threshold, total, [{'sa': sa, 'n': freq}] AS vals, cap FROM caps),\n"
    + ",\n".join(_round(level, f"o{level - 1}_open") for level in (1, 2, 3))
    + """,
groups AS (
  SELECT threshold, vals, freq, cap FROM o1_done
  UNION ALL SELECT threshold, vals, freq, cap FROM o2_done
  UNION ALL SELECT threshold, vals, freq, cap FROM o3_out),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY threshold
    ORDER BY list_transform(vals, lambda w: w.sa), freq, vals, cap) AS bucket FROM groups),
plan AS (
  SELECT threshold, bucket, u.sa AS sa, u.n AS quota, freq, cap
  FROM (SELECT threshold, bucket, freq, cap, unnest(vals) AS u FROM numbered))"""
)


def beta_plan(src: str, table: str, values) -> list[str]:
    return [table, hist(src), thresholds(values), CAPS, BETA, BUCKETS]


def overlap_plan(src: str, table: str, values) -> list[str]:
    return [table, EDGES, CLOSURE, hist(src), thresholds(values), CAPS, OVERLAP, BUCKETS]


def tclose_plan(src: str, table: str, values) -> list[str]:
    return [table, EDGES, CLOSURE, hist(src), thresholds(values), tcost(), TCLOSE, BUCKETS]


def assigned(plan: list[str], rule: str, src: str, dims: int, quotas: bool = False) -> list[str]:
    return [
        *plan,
        tree(rule),
        SEATS,
        norms(src, dims),
        QUOTA_PLACED if quotas else PLACED,
        ASSIGNED,
    ]


def mondrian(src: str, dims: int, k: int) -> str:
    cols = [f"q{i + 1}" for i in range(dims)]
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN min({c}) = max({c}) THEN 0 ELSE stddev_samp({c}) END AS s_{c}"
        for c in cols
    )
    zs = ", ".join(
        f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS z{i + 1}"
        for i, c in enumerate(cols)
    )
    names = [f"z{i + 1}" for i in range(dims)]
    ranges = ", ".join(f"max({z}) OVER w - min({z}) OVER w AS r{i + 1}" for i, z in enumerate(names))
    pick = "CASE "
    for i in range(dims - 1):
        later = " AND ".join(f"r{i + 1} >= r{j + 1}" for j in range(i + 1, dims))
        pick += f"WHEN {later} THEN {names[i]} "
    pick += f"ELSE {names[-1]} END" if dims > 1 else "WHEN true THEN z1 END"
    zl = ", ".join(names)
    return f"""mstats AS (SELECT {stats} FROM {src}),
mz AS (SELECT t.*, {zs}, md5(CAST(pid AS VARCHAR)) AS tie FROM {src} t, mstats),
part AS (
  SELECT pid, tie, {zl}, CAST(1 AS BIGINT) AS ec, count(*) OVER () AS n FROM mz
  UNION ALL
  SELECT pid, tie, {zl}, ec * 2 + CASE WHEN rn > n // 2 THEN 1 ELSE 0 END,
         CASE WHEN rn > n // 2 THEN n - n // 2 ELSE n // 2 END
  FROM (
    SELECT *, row_number() OVER (PARTITION BY ec ORDER BY v, tie) AS rn FROM (
      SELECT *, {pick} AS v FROM (
        SELECT *, {ranges} FROM part WHERE n > {2 * k} WINDOW w AS (PARTITION BY ec))))),
grouped AS (
  SELECT m.*, p.ec FROM part p JOIN mz m ON m.pid = p.pid WHERE p.n <= {2 * k})"""


# Centres: draws by the MD5 of an identifier, 13 hex digits of it as a share of 1.

SEED = 123456789


def drawn(pid: str, step: int = 0) -> str:
    text = f"concat_ws('/', CAST({pid} AS VARCHAR), '{SEED}', '{step}')"
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE)"


def random_centers(points: str, k: str) -> str:
    """One k-means step from the k rows of ``points`` (pid, i, a: one row per
    coordinate) that are drawn first: ``middle`` (cluster, i, m)."""
    return f"""names AS (SELECT DISTINCT pid FROM {points}),
seeds AS (SELECT * FROM (
  SELECT pid, row_number() OVER (ORDER BY {drawn("pid")}, md5(CAST(pid AS VARCHAR))) - 1 AS cluster FROM names)
  WHERE cluster < ({k})),
spots AS MATERIALIZED (SELECT s.cluster, p.i, p.a FROM seeds s JOIN {points} p ON p.pid = s.pid),
gaps AS (SELECT p.pid, s.cluster, sum((p.a - s.a) * (p.a - s.a)) AS d
  FROM {points} p JOIN spots s ON s.i = p.i GROUP BY p.pid, s.cluster),
near AS MATERIALIZED (SELECT pid, cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, cluster) AS rn FROM gaps) WHERE rn = 1),
moved AS (SELECT n.cluster, p.i, avg(p.a) AS m FROM near n JOIN {points} p ON p.pid = n.pid GROUP BY n.cluster, p.i),
middle AS MATERIALIZED (SELECT s.cluster, s.i, coalesce(m.m, s.a) AS m
  FROM spots s LEFT JOIN moved m ON m.cluster = s.cluster AND m.i = s.i)"""


#: Every row proposes to the next class of its list; a class keeps the closest.
MATCHED = """lists AS MATERIALIZED (
  SELECT pid, bucket, ec, room, d, row_number() OVER (PARTITION BY pid ORDER BY d, ec) AS place
  FROM (SELECT z.pid, z.bucket, s.ec, s.room, (z.z1 - c.m) * (z.z1 - c.m) AS d
        FROM waiting z JOIN room s ON s.bucket = z.bucket JOIN class_middle c ON c.ec = s.ec)),
rounds AS (
  SELECT 1 AS round, pid, CAST(1 AS BIGINT) AS place, true AS goes_on FROM waiting
  UNION ALL
  SELECT round + 1, pid, CASE WHEN rn > room THEN place + 1 ELSE place END, bool_or(rn > room) OVER () FROM (
    SELECT r.round, r.pid, r.place, l.room, row_number() OVER (
        PARTITION BY l.ec, l.bucket ORDER BY l.d, md5(CAST(r.pid AS VARCHAR))) AS rn
    FROM rounds r JOIN lists l ON l.pid = r.pid AND l.place = r.place WHERE r.goes_on)),
matched AS (
  SELECT r.pid, l.bucket, l.ec, l.d FROM rounds r JOIN lists l ON l.pid = r.pid AND l.place = r.place
  WHERE r.round = (SELECT max(round) FROM rounds))"""


def mixed_seeds(k: int, steps: int = 5) -> str:
    """k-means|| on ``pts`` (pid, z, cat), where another ``cat`` adds 1, and weighted
    k-means++ on its candidates: ``picked`` (pid, z, cat, weight, pick)."""
    import hashlib

    gap = "(p.z - f.z) * (p.z - f.z) + CASE WHEN p.cat = f.cat THEN 0 ELSE 1 END"
    out = [
        f"""keyed AS MATERIALIZED (
  SELECT *, CAST('0x' || substr(md5(CAST(pid AS VARCHAR)), 1, 15) AS BIGINT) AS id FROM pts),
f0 AS MATERIALIZED (SELECT * FROM keyed ORDER BY {drawn("pid")}, id LIMIT 1),
n0 AS MATERIALIZED (SELECT p.*, f.id AS near, {gap} AS cost FROM keyed p, f0 f)"""
    ]
    for s in range(1, steps + 1):
        out.append(
            f"""f{s} AS MATERIALIZED (SELECT pid, z, cat, id FROM n{s - 1}
  WHERE {drawn("pid", s)} * (SELECT sum(cost) FROM n{s - 1}) < {2.0 * k} * cost),
g{s} AS (SELECT * FROM (SELECT p.pid, f.id, {gap} AS far,
    row_number() OVER (PARTITION BY p.pid ORDER BY {gap}, f.id) AS rn FROM keyed p, f{s} f) WHERE rn = 1),
n{s} AS MATERIALIZED (SELECT n.pid, n.z, n.cat, n.id, CASE WHEN g.far < n.cost THEN g.id ELSE n.near END AS near,
    least(n.cost, coalesce(g.far, n.cost)) AS cost FROM n{s - 1} n LEFT JOIN g{s} g ON g.pid = n.pid)"""
        )
    chosen = " UNION ALL ".join(f"SELECT * FROM f{s}" for s in range(steps + 1))
    out.append(
        f"""cand AS MATERIALIZED (SELECT c.pid, c.z, c.cat, w.weight FROM ({chosen}) c
  JOIN (SELECT near, count(*) AS weight FROM n{steps} GROUP BY near) w ON w.near = c.id),
c0 AS (SELECT *, 1::DOUBLE AS cost FROM cand)"""
    )
    for j in range(k):
        share = int(hashlib.md5(f"pick/{SEED}/{j}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        known = f"least(p.cost, {gap})" if j else gap
        out.append(
            f"""p{j} AS MATERIALIZED (SELECT pid, z, cat, weight, {j} AS pick FROM (
  SELECT *, sum(weight * cost) OVER (ORDER BY pid) AS upto, sum(weight * cost) OVER () AS whole FROM c{j})
  WHERE upto > {share!r}::DOUBLE * whole ORDER BY pid LIMIT 1),
c{j + 1} AS MATERIALIZED (SELECT p.pid, p.z, p.cat, p.weight, {known} AS cost FROM c{j} p, p{j} f)"""
        )
    picks = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(k))
    out.append(f"picked AS ({picks})")
    return ",\n".join(out)
