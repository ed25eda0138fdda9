"""URL rules against a plain scan of all rules."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from cloakframe.llm import urls
from cloakframe.llm.queries import URL_RULES

RULES = [
    *URL_RULES,
    ("Shop.example.org", "/a", "block"),  # the beginning of a segment
    ("example.org", "/a/b", "allow"),
    ("example.org", "/a/b/", "block"),
    ("example.org", None, "allow"),  # a host alone
    ("both.org", "/", "allow"),
    ("both.org", "/", "block"),
    ("both.org", "/", "allow"),
    ("io", "", "block"),
    (None, "/", "block"),
]
URLS = [
    None, "", "no scheme", "dns:www.example.com", "://", "http://", "http://com", "http://com/", "HTTP://COM/x",
    "http://example.com/en", "http://example.com/en/", "http://example.com/en/x?u=://net/es/", "http://example.com?/en/",
    "http://example.com#/en/", "http://www.example.com/en/x", "http://a.www.example.com/en/x", "http://wwwexample.com/en/",
    "http://aexample.com/en/y", "http://net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://x.net:80/fr/", "http://x.net./fr/",
    "http://u@x.net/fr/", "http://shop.example.org/abc/b", "http://shop.example.org/a/b/c", "http://example.org/a/bc", "http://example.org/a/b/c",
    "http://example.org", "http://both.org/", "http://x.both.org/y", "http://io", "http://x.io/" + "long/" * 5000, "http://Ä.NET/FR/", "http://Ä.NET/fr/",
    "http://x.net/fr/\n/y", "http://x.net//fr/",
]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    stop = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:].split("?")[0].split("#")[0]
    best = None
    for rule_host, rule_path, verdict in rules:
        if rule_host is None:
            continue
        rule_host, rule_path = rule_host.lower(), rule_path or ""
        fits = not rule_host or host == rule_host or host.endswith("." + rule_host)
        if fits and path.startswith(rule_path):
            labels = rule_host.count(".") + 1 if rule_host else 0
            rank = (labels, len(rule_path), verdict == "block")
            best = max(best or (rank,), (rank, rule_host + rule_path, verdict))
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


SCHEMA = "page_id long, url string, rule string, extra int"


@pytest.mark.parametrize("max_bytes", [1 << 20, 1500])
def test_every_case(spark, max_bytes):
    rows = [(i, u, "own", None) for i, u in enumerate(URLS)] + [(None, URLS[14], None, 1)] * 2
    pages = spark.createDataFrame(rows, SCHEMA)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urls.judge(pages, rules, keep=["page_id", "rule"], max_bytes=max_bytes)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = Counter((r[0], *plain(r[1], RULES)) for r in rows)
    assert Counter(map(tuple, found.collect())) == want


def test_random_rules_in_parts(spark):
    draw = random.Random(5)
    host = lambda k: ".".join(draw.choice("abc") for _ in range(draw.randint(0, k)))
    path = lambda k: "".join("/" + draw.choice(["", "x", "y", "xy"]) for _ in range(draw.randint(0, k)))
    rules = [(host(3), path(3), draw.choice(["allow", "block"])) for _ in range(120)]
    rows = [(i, f"s://{host(5)}{path(5)}", None, None) for i in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA)
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    for max_bytes in (1 << 20, 12_000):
        found = urls.judge(pages, given, ["page_id"], default="block", max_bytes=max_bytes).collect()
        assert Counter(map(tuple, found)) == Counter((r[0], *plain(r[1], rules, "block")) for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b", None, None)], SCHEMA)
    assert [tuple(r) for r in urls.judge(pages, none, ["page_id"]).collect()] == [(1, "a", "/b", None, "allow")]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert urls.judge(pages.limit(0), rules, ["page_id"]).collect() == []
