"""Every query with an oracle against DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from conftest import SMALL
from terrafringe.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events", "embeddings"):
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def ordered(rows, columns, by):
    at = [columns.index(c) for c in sorted(by)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, tables, name):
    found = QUERIES[name](spark, SMALL)
    expected = tables.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert ordered(found.collect(), found.columns, found.columns) == ordered(expected.fetchall(), expected.columns, found.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
