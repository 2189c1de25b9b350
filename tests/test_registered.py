"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{path}'")
    return con


def tidy(value):
    value = round(value, 9) if isinstance(value, float) else value
    return (value is None, str(value))


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) == sum(len(m.QUERIES) for m in contract._MODULES)


def test_entry(spark):
    assert contract.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([tuple(tidy(r[c]) for c in columns) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert got == sorted([tuple(tidy(r[i]) for i in order) for r in result.fetchall()])
