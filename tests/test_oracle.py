"""Every registered query against its SQL, row by row."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from carbonhaul.queries.catalog import QUERIES as CATALOG
from tools.check_oracle import TABLES, rows

# the training-data queries have tests of their own
QUERIES = {name: run for name, run in entry.queries().items() if name in CATALOG}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in CATALOG}


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) == set(CATALOG)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns, got = rows(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    expected_columns, expected = rows([d[0] for d in result.description], result.fetchall())
    assert columns == expected_columns
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
