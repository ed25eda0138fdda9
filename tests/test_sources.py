"""Readers that set bad rows aside, and assigned tables in buckets."""

from __future__ import annotations

import cloakframe as cf
from cloakframe.operators import audit, stats
from cloakframe.sources import microdata

ROLES = cf.Roles("id", ["age"], "wage", ["city"])


def test_rejected_lines(spark, tmp_path):
    lines = ["1,30,x,low", "2,old,x,low", "3,NaN,x,low", "4,,x,low", "5,31,x,", "6,32", "7,33,x,low,more", ",34,x,low",
             '8,35,"a, b",high', "", "9,-Infinity,y,low", "10,1e3,y,high"]
    path = tmp_path / "rows.csv"
    path.write_text("\n".join(lines) + "\n")
    load = microdata.load_with_rejects(spark, str(path), ROLES, "csv", ["id", "age", "city", "wage"])
    assert load.rows.columns == ["id", "age", "city", "wage"] and dict(load.rows.dtypes)["age"] == "double"
    assert {tuple(r) for r in load.rows.collect()} == {
        ("1", 30.0, "x", "low"), ("8", 35.0, "a, b", "high"), ("10", 1000.0, "y", "high")
    }
    found = {(r.id, r.reason, r.record) for r in load.rejects.collect()}
    assert found == {
        ("2", "age: not a number", None), ("3", "age: not finite", None), ("4", "age: missing", None),
        ("5", "wage: missing", None), ("6", "wrong number of fields", "6,32"),
        ("7", "wrong number of fields", "7,33,x,low,more"), (None, "id: missing", None), ("9", "age: not finite", None),
    }
    assert load.rows.count() == 3 and load.rejects.count() == 8  # also with no column asked for
    again = load.write_rejects(str(tmp_path / "rejects"))
    assert again.where("id = '2'").first().age == "old"


def test_rejected_rows_of_a_typed_table(spark, tmp_path):
    rows = [(1, "5", "x", "a", "r"), (2, "five", "x", "a", "r"), (3, "6", None, "a", "r"), (4, "7", "x", None, "r"), (None, "8", "x", "a", "r")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id int, age string, city string, wage string, reason string").write.parquet(path)
    load = microdata.load_with_rejects(spark, path, ROLES)
    assert [tuple(r) for r in load.rows.collect()] == [(1, 5.0, "x", "a")]
    assert {(r.id, r.reason) for r in load.rejects.collect()} == {
        ("2", "age: not a number"), ("3", "city: missing"), ("4", "wage: missing"), (None, "id: missing")
    }


def test_empty_source(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("")
    load = microdata.load_with_rejects(spark, str(path), ROLES, "csv", ["id", "age", "city", "wage"])
    assert load.rows.count() == 0 and load.rejects.count() == 0


def test_audits_of_a_bucketed_table_do_not_shuffle(spark):
    df = spark.range(400).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS age", "'x' AS city", "CONCAT('w', id % 4) AS wage")
    assigned = cf.assign_classes(df, ROLES, cf.class_plan(df, "wage", "beta", 1.0))
    want = {tuple(r) for r in stats.ec_sizes(assigned).collect()}
    kept = microdata.write_assigned_table(assigned, "assigned_for_audit", 4)
    try:
        for made in (stats.ec_sizes(kept), stats.ec_means(kept, ["age"]), stats.ec_ranges(kept, ["age"]), audit.class_value_counts(kept, "wage")):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
        assert {tuple(r) for r in stats.ec_sizes(kept).collect()} == want
    finally:
        microdata.drop_assigned_table(spark, "assigned_for_audit")
    assert not spark.catalog.tableExists("assigned_for_audit")
