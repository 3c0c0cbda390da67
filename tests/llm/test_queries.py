"""The training-data queries against their SQL, and every one on an empty table."""
import os

import pytest

from tessera.llm import catalog
from tests.oracle import DATA, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, name):
    compare(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], connect())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    df = catalog.queries()[name](spark, str(tmp_path))
    assert df.columns and df.count() == 0
