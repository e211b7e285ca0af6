"""Every registered query runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest

from loreweave import queries
from tests.compare import connect, same

QUERIES, ORACLES = queries.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
