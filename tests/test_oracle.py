"""Every registered query with SQL must equal it in DuckDB; the others must give rows."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from verify import compare

RUNS, SQLS = queries(), oracle_sql()
# Fits of several models; covered by tests/test_models.py on a fixture.
SLOW = {"forest_grid_search"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(SQLS) - SLOW))
def test_equals_sql(spark, con, name):
    assert compare(RUNS[name](spark, SMALL), SQLS[name], con) is None


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQLS) - SLOW))
def test_gives_rows(spark, name):
    assert not RUNS[name](spark, SMALL).isEmpty()
