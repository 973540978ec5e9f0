"""Every registered query beside the SQL that says the same, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tarnish.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(repr, r))
    ours = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key)
    assert ours == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 14
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
