"""Every bound query against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from wardlight.plans.driver_queries import QUERIES
from wardlight.plans.driver_sql import SQL
from wardlight.sources.driver_tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    result = duck.execute(SQL[name])
    places = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(places) == columns
    want = sorted(repr(tuple(plain(row[places[c]]) for c in columns)) for row in result.fetchall())
    assert got == want
