"""Every registered query with SQL must equal DuckDB on the same small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, check

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    message, _, ok = check(spark, con, name, QUERIES[name], SQL[name], DATA)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
