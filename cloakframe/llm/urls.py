"""Allow and block rules for URLs, by the longest match in a trie.

A rule is a host and the beginning of a path. The trie's keys are the host's labels
from the last to the first and then the segments of the path; the last segment of
a rule may be the beginning of one. A rule fits its host and every subdomain of it,
if the URL's path starts with the rule's, character by character. Of the rules that
fit, the one with the most host labels decides, and among these the one with the
longest path; the same host and path in both lists is blocked. A URL that no rule
fits gets ``default`` (allow).

The trie is flat (two dictionaries) and is broadcast in parts of at most
``max_bytes``: with more rules than one part holds, every part is one pass over the
URLs that keeps the best match so far. No row is shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path; a
port or user name is part of the host as it stands; repeated rows are judged one by
one; an empty table gives an empty result. Rules: a null host is no rule, an empty
one fits every URL, a null path is an empty one, repeated rules count once; without
rules every URL gets the default. A column to keep that is named like a result
(``host``, ``path``, ``rule``, ``verdict``) gives way to the result.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import materialize
from cloakframe.runtime import discard

#: Bytes of rules (with what a trie needs for each) that one broadcast may hold.
MAX_BYTES = 64 << 20
RULE_BYTES = 400
RESULTS = ("host", "path", "rule", "verdict")
#: Edge from a host to its paths; no label and no segment holds it.
_PATHS = "/"

Trie = tuple[dict[tuple[int, str], int], dict[int, tuple[int, ...]], dict[tuple[int, str], tuple[str, str, int]]]


def lower_ascii(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: str) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    url = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Trie:
    """(edges, lengths of the last segments at a node, rules at a node and last segment)."""
    edges: dict[tuple[int, str], int] = {}
    ends: dict[tuple[int, str], tuple[str, str, int]] = {}
    for host, path, verdict in rules:
        labels = host.split(".")[::-1] if host else []
        *segments, last = path.split("/")
        at = 0
        for key in (*labels, _PATHS, *segments):
            at = edges.setdefault((at, key), len(edges) + 1)
        known = ends.get((at, last))
        if known is None or verdict == "block":
            ends[at, last] = (host + path, verdict, len(labels))
    lengths: dict[int, set[int]] = {}
    for at, last in ends:
        lengths.setdefault(at, set()).add(len(last))
    return edges, {at: tuple(sorted(some, reverse=True)) for at, some in lengths.items()}, ends


def _hosts(trie: Trie, host: str) -> list[int]:
    """Roots of the paths of the rules' hosts that the host lies in, the deepest first."""
    edges, at, found = trie[0], 0, []
    if (root := edges.get((0, _PATHS))) is not None:
        found.append(root)
    for label in host.split(".")[::-1]:
        at = edges.get((at, label))
        if at is None:
            break
        if (root := edges.get((at, _PATHS))) is not None:
            found.append(root)
    return found[::-1]


def _longest(trie: Trie, root: int, segments: Sequence[str]) -> tuple[str, str, int] | None:
    """The rule with the longest path below ``root`` that the path starts with."""
    edges, lengths, ends = trie
    best, at = None, root
    for i, segment in enumerate(segments):
        for length in lengths.get(at, ()):
            rule = ends.get((at, segment[:length])) if length <= len(segment) else None
            if rule is not None:
                best = rule
                break
        # A segment is complete only where another one follows.
        if i + 1 == len(segments) or (at := edges.get((at, segment))) is None:
            break
    return best


def match(trie: Trie, host: str, path: str) -> tuple[str, str, int] | None:
    """(rule, verdict, host labels) of the longest match, or None."""
    segments = path.split("/")
    for root in _hosts(trie, host):
        if (rule := _longest(trie, root, segments)) is not None:
            return rule
    return None


def _matcher(shared):
    @F.pandas_udf("rule string, verdict string, labels int")
    def matched(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = shared.value
        known: dict[str, list[int]] = {}
        found = []
        for h, p in zip(host, path):
            if h not in known:
                known[h] = _hosts(trie, h)
            segments = p.split("/")
            hits = (_longest(trie, root, segments) for root in known[h])
            found.append(next((x for x in hits if x is not None), (None, None, None)))
        made = pd.DataFrame(found, columns=["rule", "verdict", "labels"])
        return made.astype({"labels": "Int32"})

    return matched


def judge(
    pages: DataFrame,
    rules: DataFrame,
    keep: Sequence[str],
    url_col: str = "url",
    default: str = "allow",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The ``keep`` columns, and the host, path, deciding rule and verdict of each URL.

    ``rules`` has host, path and verdict (allow or block).
    """
    given = rules.where("host IS NOT NULL").select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    size = F.octet_length("host") + F.octet_length("path") + F.lit(RULE_BYTES)
    total = given.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-total // max_bytes))
    kept = [c for c in keep if c not in RESULTS]
    host, path = url_parts(url_col)
    none = F.lit(None).cast("string")
    out = pages.select(*kept, host.alias("host"), path.alias("path"), none.alias("rule"), none.alias("verdict"))
    out = out.withColumn("_labels", F.lit(None).cast("int"))
    context = pages.sparkSession.sparkContext
    for part in range(parts):
        here = given.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part)
        shared = context.broadcast(build_trie(map(tuple, here.toLocalIterator())))
        found = out.withColumn("_hit", _matcher(shared)("host", "path"))
        # Texts of rules that fit one URL and have equally many labels have one host.
        longer = (F.col("_hit.labels") > F.col("_labels")) | (
            (F.col("_hit.labels") == F.col("_labels"))
            & (F.char_length("_hit.rule") > F.char_length("rule"))
        )
        better = F.col("_hit.rule").isNotNull() & (F.col("rule").isNull() | longer)
        result = found.select(
            *kept,
            "host",
            "path",
            *[F.when(better, F.col(f"_hit.{c}")).otherwise(F.col(c)).alias(c) for c in ("rule", "verdict")],
            F.when(better, F.col("_hit.labels")).otherwise(F.col("_labels")).alias("_labels"),
        )
        if part + 1 < parts:
            result = materialize(result, "urls")
            if part:
                discard(out)
            shared.unpersist()
        out = result
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
