"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenvec.queries import SQL, Q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as from '{sf}/{f}'")
    return con


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, sf, name):
    df = Q[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    assert name in SQL
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert got == sorted(([plain(r[names.index(c)]) for c in cols] for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
