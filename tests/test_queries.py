"""Every query against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from oracle import connect, difference
from tessella.plans import queries as plans


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_rows_equal(name, spark, sf, con):
    assert difference(plans.QUERIES[name](spark, sf), con, plans.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(name, spark, sf):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
