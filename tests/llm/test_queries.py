"""Every query: against its SQL twin where there is one, else that it returns its documents."""

import pytest

import __spark_entry__ as entry
from fieldloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_registered():
    names = entry.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names
