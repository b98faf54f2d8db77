"""Every registered query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from stratalens.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return str(v)
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows
    if name in SQL:
        r = duck.sql(SQL[name])
        assert sorted(r.columns) == cols
        want = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
        assert sorted(tuple(plain(x[c]) for c in cols) for x in rows) == sorted(tuple(plain(x[c]) for c in cols) for x in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 1
    assert set(e.oracle_sql()) <= set(e.queries())
