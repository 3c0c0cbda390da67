"""Every registered column query against its SQL, at the smallest size."""
import os

import pytest

import __spark_entry__ as entry
from tessera.plans import catalog
from tests.oracle import DATA, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
    else:
        compare(df, sql, con)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["chunk_id", "page_id", "n", "bits_per_number"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_read_what_they_need(spark):
    plan = catalog.queries()["bin_membership"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "o_orderstatus" not in plan
