"""WARC revisit records of the not-modified profile, resolved to their responses.

A revisit record says that a server answered "not modified"; it holds headers but
no body. It stands for the latest full response to the same canonical URL that is
earlier than the revisit, provided the validators agree. That is an as-of join: in
the order of (URL, time) each record looks back to the last response before it.
The records of a URL are dealt over blocks (see ``blocks``), and a block hands its
last response on to the next, so a URL with a third of all records is no single
task. Bodies take no part; only their digests travel.

Validators: with an entity tag on both sides the tags decide, compared weakly
(``W/`` is left out); otherwise with a modification date on both sides the dates
decide; otherwise with a payload digest on both sides the digests decide. Headers
that a 304 answer may renew (``PERMITTED``) replace the response's; all others
stay as the response had them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.blocks import BLOCK, attach, inside, ordered_blocks

#: Header fields of a 304 answer that update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a visit, not a resource.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


UNRESERVED = string.ascii_letters + string.digits + "-._~"


def _percent_normal(u: Column) -> Column:
    """Percent-encoded octets in upper case; those of unreserved characters decoded."""
    plain = F.create_map(*[F.lit(x) for c in UNRESERVED for x in (f"{ord(c):02X}", c)])
    code = lambda x: F.upper(F.substring(x, 1, 2))
    told = lambda x: F.concat(
        F.coalesce(F.try_element_at(plain, code(x)), F.concat(F.lit("%"), code(x))), F.substring(x, 3, 1 << 30)
    )
    first, rest = F.split(u, "%", 2), F.split(F.regexp_extract(u, "(?s)%(.*)", 1), "%", -1)
    spelled = F.transform(rest, lambda x: F.when(x.rlike("^[0-9A-Fa-f]{2}"), told(x)).otherwise(F.concat(F.lit("%"), x)))
    return F.when(F.size(first) > 1, F.concat(first[0], F.array_join(spelled, ""))).otherwise(u)


def canonical_url(url: str) -> Column:
    """Host and path that name the resource: no scheme, user name, ``www.``, default
    port of the scheme, fragment, tracking parameters or closing slash; dot segments
    resolved, percent-encoding in one spelling, other parameters sorted.

    A URL without a scheme and a host (``dns:`` records, relative ones) stands for
    itself as it is spelled; a null URL has no key.
    """
    u = _percent_normal(F.col(url))
    rest = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
    scheme = F.lower(F.regexp_extract(u, "^[^:]*", 0))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":$", "")
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443")
    host = F.when(F.endswith(host, port), F.regexp_replace(host, r":[0-9]+$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    segments = F.split(F.regexp_extract(u, rest + r"([^?#]*)", 1), "/", -1)
    path = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.lit(""),
        lambda before, s: F.when(s == ".", before)
        .when(s == "..", F.regexp_replace(before, "/[^/]*$", ""))
        .otherwise(F.concat(before, F.lit("/"), s)),
    )
    query = F.split(F.regexp_extract(u, rest + r"[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    args = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    named = F.concat(host, F.regexp_replace(path, "/+$", ""), args)
    return F.when(host != "", named).otherwise(F.col(url))


def _name(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ":", 1)))


def merged_headers(response: Column, revisit: Column) -> Column:
    """Header lines ``name: value`` after the revisit, sorted."""
    empty = F.array().cast("array<string>")
    new = F.filter(F.coalesce(revisit, empty), lambda h: _name(h).isin(*PERMITTED))
    names = F.transform(new, _name)
    old = F.filter(F.coalesce(response, empty), lambda h: ~F.array_contains(names, _name(h)))
    return F.array_sort(F.concat(old, new))


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with its canonical URL, status, response and merged headers.

    ``records``: record_id, url, ts (time, any ordered type), kind ('response' or
    'revisit'), etag, last_modified, digest, headers (array of ``name: value``).
    Status of a revisit: ``resolved``; ``mismatch`` (the latest earlier response
    has other validators); ``unverified`` (no validator on both sides); ``orphan``
    (no earlier response; also with a null URL or time). Only resolved ones have
    ``response_id`` and merged headers. A response has the status ``response``,
    itself as ``response_id`` and its own headers, sorted. Records of other kinds
    get the status ``other``. A response of the same time is not earlier; of
    several at one time the one with the largest record_id is the latest. A null
    header line stays out. Repeated records each give a row.
    """
    fields = ["record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers"]
    rows = records.select(*fields).withColumns(
        {
            "url_key": canonical_url("url"),
            "headers": F.filter("headers", lambda h: h.isNotNull()),
            # at one time, revisits come before responses
            "_late": (F.coalesce(F.col("kind"), F.lit("")) == "response").cast("int"),
        }
    )
    group, order = ["url_key"], ["ts", "_late", "record_id"]
    rows = ordered_blocks(rows, group, order, "records")
    full = F.when(
        (F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("ts").isNotNull(),
        F.struct("record_id", "etag", "last_modified", "digest", "headers"),
    )
    rows = rows.withColumn("_full", full)
    last = rows.where(F.col("_full").isNotNull()).groupBy("url_key", BLOCK).agg(
        F.max_by("_full", F.struct("ts", "record_id", "_row")).alias("_last")
    )
    before = Window.partitionBy("url_key").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # every block of a URL, also those without a response of their own
    held = rows.select("url_key", BLOCK).distinct().join(last, ["url_key", BLOCK], "left")
    held = held.withColumn("_handed", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    look_back = inside(group, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_full", ignorenulls=True).over(look_back))
    found = attach(rows, held, group).withColumn("_r", F.coalesce("_near", "_handed"))

    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("_r").isNotNull()
    both = lambda c: F.col(c).isNotNull() & F.col(f"_r.{c}").isNotNull()
    agree = (
        F.when(both("etag"), _tag(F.col("etag")) == _tag(F.col("_r.etag")))
        .when(both("last_modified"), F.col("last_modified") == F.col("_r.last_modified"))
        .when(both("digest"), F.col("digest") == F.col("_r.digest"))
    )
    status = (
        F.when(F.col("kind") == "response", "response")
        .when(F.coalesce(F.col("kind"), F.lit("")) != "revisit", "other")
        .when(~usable, "orphan")
        .when(agree.isNull(), "unverified")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    return found.withColumn("status", status).select(
        "record_id",
        "url_key",
        "ts",
        "kind",
        "status",
        F.when(F.col("status") == "resolved", F.col("_r.record_id"))
        .when(F.col("status") == "response", F.col("record_id"))
        .alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(F.col("_r.headers"), F.col("headers")))
        .when(F.col("status") == "response", F.array_sort("headers"))
        .alias("headers"),
    )
