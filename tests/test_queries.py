"""Every registered query against its SQL (``TEST_SF_DIR``, default sf0.001)."""

import os

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_acctbal", "c_mktsegment", "n_name"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows = compare.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert not problem
    assert rows > 0 or name == "join_frontier"
