"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lanewise.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spelled(v):
    return repr(v) if isinstance(v, float) else str(v)


def same(spark, sf, name, queries, oracles):
    df = queries[name](spark, sf)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = con.execute(oracles[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(tuple(spelled(r[i]) for i in order) for r in got.fetchall())
    assert sorted(tuple(spelled(v) for v in r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    same(spark, small, name, QUERIES, ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
