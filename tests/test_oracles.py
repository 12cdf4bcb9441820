"""Every registered query with an SQL twin gives the twin's rows."""

import glob
import math
import os

import duckdb
import pytest

from keystrata.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLES[name])
    assert got == rows([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0
