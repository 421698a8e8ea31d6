"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from fieldloom.plans import load_queries
from tests.compare import compare, connect

QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["c"] for r in sorted(rows, key=lambda r: r["c"])] == [0, 1, 2, 3]


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
