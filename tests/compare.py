"""Run registered queries next to their SQL in DuckDB and compare.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def differences(got, want, limit=3):
    (names_a, a), (names_b, b) = got, want
    if names_a != names_b:
        return f"columns {names_a} / {names_b}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}; e.g. {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[:limit]}" if bad else ""


def compare(spark, con, name, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    columns = frame.columns
    got = sorted_rows(columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return "", len(got[1])
    cursor = con.execute(sql)
    want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    return differences(got, want), len(got[1])


def main(argv):
    from conftest import make_spark

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_spark(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv[1:] or queries:
        began = time.time()
        try:
            problem, rows = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # a report, not a test
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        took = time.time() - began
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:28s} {rows:8d} rows {took:6.1f} s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
