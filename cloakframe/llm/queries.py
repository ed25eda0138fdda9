"""The queries of this subpackage on the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import (
    alignment,
    chat,
    decontaminate,
    lm,
    packing,
    phrases,
    quality,
    repeats,
    revisits,
    sharding,
    simhash,
    topk,
    urls,
)
from cloakframe.llm.common import text_key, whole
from cloakframe.llm.quality import KEEP_SCORE, held_out
from cloakframe.runtime import small_side

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_lm_cross_entropy_difference(spark, d):
    """Target: documents that are labelled good; background: all documents."""
    good = table(spark, d, "labels").where("quality = 1 AND doc_id IS NOT NULL")
    good = good.select(F.col("doc_id").alias("good")).distinct()
    docs = table(spark, d, "documents").select("doc_id", "text")
    side = small_side(good, good.count())
    marked = docs.join(side, docs["doc_id"] == side["good"], "left")
    marked = marked.select("doc_id", "text", F.col("good").isNotNull().alias("is_target"))
    return lm.cross_entropy_difference(marked, "is_target", keep=["doc_id"])


_REPEATS_SQL = """
WITH d AS (SELECT doc_id, b, octet_length(b) AS n FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)),
w AS (SELECT doc_id, p, md5(b[p:p + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS p FROM d WHERE n >= 400)),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 399 AS z FROM k GROUP BY doc_id, k),
kept AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(s.z), 0) + 1, max(d.n) FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, n - CAST(sum(kept.z - kept.a + 1) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(CASE WHEN kept.a <= kept.z THEN hex(b[kept.a:kept.z]) ELSE '' END, '' ORDER BY kept.a))) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id GROUP BY d.doc_id, n"""


@query(_REPEATS_SQL)
def op2_suffix_array_dedup(spark, d):
    docs = table(spark, d, "documents")
    found = repeats.remove_repeats(docs, length=400, with_kept=False).select(
        "key", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
    return docs.select("doc_id", text_key("text").alias("key")).join(found, "key").drop("key")


@query()
def op3_quality_classifier(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    weights = quality.fit(quality.training_rows(docs, labels.where(~held_out("doc_id"))), "text", "y", "at")
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


@query()
def op4_simhash_near_dedup(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query()
def op5_sharding_histogram_sort(spark, d):
    text = whole("text")
    rows = table(spark, d, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    )
    placed = sharding.shard_by_bytes(rows, "size", ["content"], shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """WARC records that the pages give: a response each, and revisits around it.

    A revisit with the response's tag follows every page; some pages also have one
    with another tag, one before the response, and one that only has a date. Their
    URLs name the page in another spelling.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    when = F.concat(F.lit("day "), F.col("page_id") % 1000)
    other = F.concat(F.regexp_replace("url", "^http://", "https://"), F.lit("#r"))
    page = F.col("page_id")

    def record(k, after, kind, etag, date, url):
        at = page * 10 + after
        lines = [
            F.concat(F.lit("Date: "), at),
            F.concat(F.lit("Cache-Control: max-age="), F.lit(k)),
            F.when(etag.isNotNull(), F.concat(F.lit("ETag: "), etag)),
            F.lit("Content-Type: text/html") if kind == "response" else F.lit("Server: cache"),
        ]
        if kind == "response":
            lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(F.col("html"))))
        return F.struct(
            (page * 10 + k).alias("record_id"),
            url.alias("url"),
            at.alias("ts"),
            F.lit(kind).alias("kind"),
            etag.alias("etag"),
            date.alias("last_modified"),
            (F.md5("html") if kind == "response" else F.lit(None).cast("string")).alias("digest"),
            F.array(*lines).alias("headers"),
        )

    none = F.lit(None).cast("string")
    records = F.array(
        record(0, 0, "response", tag, when, F.col("url")),
        record(1, 3, "revisit", F.concat(F.lit("W/"), tag), none, other),
        F.when(page % 3 == 0, record(2, 5, "revisit", F.lit('"old"'), none, F.col("url"))),
        F.when(page % 5 == 0, record(3, -1, "revisit", tag, none, other)),
        F.when(page % 7 == 0, record(4, 7, "revisit", none, when, other)),
    )
    return pages.select(F.inline(F.filter(records, lambda r: r.isNotNull())))


_WARC_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '^http://', 'https://') || '#r' AS other, md5(html) AS digest,
    '"' || md5(html)[1:16] || '"' AS tag, 'day ' || (page_id % 1000) AS day, strlen(html) AS n FROM pages),
log AS (
  SELECT page_id * 10 AS record_id, url, page_id * 10 AS ts, 'response' AS kind, tag AS etag, day AS last_modified, 0 AS k, n FROM p
  UNION ALL SELECT page_id * 10 + 1, other, page_id * 10 + 3, 'revisit', 'W/' || tag, NULL, 1, n FROM p
  UNION ALL SELECT page_id * 10 + 2, url, page_id * 10 + 5, 'revisit', '"old"', NULL, 2, n FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 10 + 3, other, page_id * 10 - 1, 'revisit', tag, NULL, 3, n FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT page_id * 10 + 4, other, page_id * 10 + 7, 'revisit', NULL, day, 4, n FROM p WHERE page_id % 7 = 0),
octets AS (SELECT *, string_split(url, '%') AS o FROM log),
spelled AS (SELECT * EXCLUDE (o), o[1] || array_to_string([CASE WHEN NOT regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN '%' || x
    WHEN regexp_matches(chr(CAST('0x' || x[1:2] AS INTEGER)), '^[A-Za-z0-9._~-]$') THEN chr(CAST('0x' || x[1:2] AS INTEGER)) || x[3:]
    ELSE '%' || upper(x[1:2]) || x[3:] END FOR x IN o[2:]], '') AS u FROM octets),
parts AS (SELECT *, lower(regexp_extract(u, '^[^:]*')) AS scheme,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':$', '') AS host,
    regexp_replace(list_reduce(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda b, x:
      CASE x WHEN '.' THEN b WHEN '..' THEN regexp_replace(b, '/[^/]*$', '') ELSE b || '/' || x END), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS args FROM spelled),
named AS (SELECT *, regexp_replace(CASE WHEN (scheme = 'http' AND host LIKE '%:80') OR (scheme = 'https' AND host LIKE '%:443')
      THEN regexp_replace(host, ':[0-9]+$', '') ELSE host END, '^www\.', '') AS bare FROM parts),
rec AS (SELECT *, CASE WHEN bare = '' THEN url ELSE
    bare || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS url_key FROM named),
res AS (SELECT * FROM rec WHERE kind = 'response'),
near AS (SELECT v.*, r.record_id AS rid, r.etag AS retag, r.last_modified AS rday, r.ts AS rts, r.n AS rn
  FROM (SELECT * FROM rec WHERE kind = 'revisit') v ASOF LEFT JOIN res r ON v.url_key = r.url_key AND v.ts > r.ts),
told AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = retag THEN 'resolved' ELSE 'mismatch' END
    WHEN last_modified = rday THEN 'resolved' ELSE 'mismatch' END AS status FROM near)
SELECT record_id, url_key, ts, kind, 'response' AS status, record_id AS response_id,
  array_to_string(list_sort(['Date: ' || ts, 'Cache-Control: max-age=0', 'ETag: ' || etag, 'Content-Type: text/html', 'Content-Length: ' || n]), chr(10)) AS headers
FROM res UNION ALL
SELECT record_id, url_key, ts, kind, status, CASE WHEN status = 'resolved' THEN rid END,
  CASE WHEN status = 'resolved' THEN array_to_string(list_sort(['Date: ' || ts, 'Cache-Control: max-age=' || k,
    'ETag: ' || coalesce(etag, retag), 'Content-Type: text/html', 'Content-Length: ' || rn]), chr(10)) END FROM told"""


@query(_WARC_SQL)
def op6_warc_revisit_resolution(spark, d):
    """The pages' capture log with its revisits resolved."""
    found = revisits.resolve_revisits(capture_log(table(spark, d, "pages")))
    return found.withColumn("headers", F.array_join("headers", "\n"))


_TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS asked, vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.asked, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY asked ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query(_TOPK_SQL)
def op7_exact_topk_search(spark, d):
    vectors = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), topk.quantise("embedding").alias("vector")
    )
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), k=20)


_LEAKS_SQL = r"""
WITH dt AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i, len(t) AS n FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)),
it AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS j, len(t) AS m FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark)),
same AS (SELECT doc_id, item_id, i - j AS d, j, m, n FROM dt JOIN it ON dt.w = it.w),
near AS (SELECT doc_id, item_id, d, m, n FROM same GROUP BY ALL HAVING 5 * count(*) >= 4 * least(13, m)),
place AS (SELECT *, unnest(range(greatest(0, -d), least(m, n - d))) AS j FROM near),
mark AS (SELECT p.*, CASE WHEN s.j IS NULL THEN -4 ELSE 1 END AS v FROM place p LEFT JOIN same s
    ON s.doc_id = p.doc_id AND s.item_id = p.item_id AND s.d = p.d AND s.j = p.j),
run AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, d ORDER BY j) AS upto,
    sum(CASE WHEN v = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id, d ORDER BY j) AS hits FROM mark),
part AS (SELECT a.doc_id, a.item_id, a.d, a.m, a.j AS lo, z.j - a.j + 1 AS len,
    z.hits - a.hits + CASE WHEN a.v = 1 THEN 1 ELSE 0 END AS eq FROM run a JOIN run z
    ON z.doc_id = a.doc_id AND z.item_id = a.item_id AND z.d = a.d AND z.j >= a.j AND z.upto >= a.upto - a.v),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len DESC, d, lo) AS k FROM part WHERE len >= least(13, m))
SELECT doc_id, item_id, CAST(d + lo AS INTEGER) AS token_start, CAST(len AS INTEGER) AS n_tokens,
  CAST(eq AS INTEGER) AS n_equal FROM best WHERE k = 1"""


@query(_LEAKS_SQL)
def op8_benchmark_decontamination(spark, d):
    """A row per document and test item that it holds."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    return decontaminate.contaminated(docs, items, keep=["doc_id"])


_CHAT_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER w AS position,
    string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3)) OVER w AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
n AS (SELECT conv_id, max(position) AS n FROM t GROUP BY conv_id),
whole AS (SELECT t.prefix, min(conv_id) AS conv_id FROM t JOIN n USING (conv_id) WHERE position = n GROUP BY t.prefix),
inner_ AS (SELECT DISTINCT t.prefix FROM t JOIN n USING (conv_id) WHERE position < n),
kept AS (SELECT conv_id FROM whole ANTI JOIN inner_ USING (prefix))
SELECT conv_id, CAST(position AS INTEGER) AS position, '<|im_start|>' || coalesce(role, '') || chr(10)
  || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM t SEMI JOIN kept USING (conv_id)"""


@query(_CHAT_SQL)
def op9_chat_snapshot_collapse(spark, d):
    """The turns of every maximal conversation, rendered."""
    return chat.format_chats(table(spark, d, "conversations"))


@query()
def op10_best_fit_packing(spark, d):
    docs = table(spark, d, "documents")
    return packing.pack_documents(docs, keep=["doc_id"], capacity=1024)


#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_URLS_SQL = r"""
WITH rules(rhost, rpath, said) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(rhost) DESC, length(rpath) DESC) AS place
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(said, 'allow') AS verdict FROM f WHERE place = 1"""


@query(_URLS_SQL)
def op11_url_filters(spark, d):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, d, "pages"), rules, keep=["page_id"])


@query()
def op12_cross_tokenizer_alignment(spark, d):
    return alignment.align_documents(table(spark, d, "documents"), keep=["doc_id"])


_PHRASES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT k, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS j, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
grams AS (SELECT lang, ws[i:i + m - 1] AS g FROM starts, range(1, 6) s(m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(g) > 1),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
scored AS (SELECT cuts.*, l.a AS l, r.a AS r, n,
    (CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = cuts.g[1:k] JOIN f r ON r.lang = cuts.lang AND r.g = cuts.g[k + 1:]
  JOIN total ON total.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, g[i:i + m - 1] AS g, a FROM c, range(1, 6) o(i), range(2, 5) s(m)
  WHERE m < len(g) AND i + m - 1 <= len(g)),
longest AS (SELECT lang, g, max(a) AS most FROM inside GROUP BY lang, g),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longest USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang
    ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n,
    CAST(score AS BIGINT) AS score FROM kept) WHERE rank <= 2000"""


@query(_PHRASES_SQL)
def op13_phrase_collocations(spark, d):
    return phrases.collocations(table(spark, d, "documents"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)
