"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from lexiforge import plans

from .oracle import connected, differences

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(DIR)


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert not differences(plans.queries()[name](spark, DIR), con, plans.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
