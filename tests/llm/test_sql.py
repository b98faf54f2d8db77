"""The operators that SQL can express against their SQL, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from stratalens.llm.queries import SQL, queries
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(SQL))
def test_operator(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = queries()[name](spark, data)
    rows, cols, r = df.collect(), sorted(df.columns), con.sql(SQL[name])
    assert sorted(r.columns) == cols
    want = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
    assert sorted(tuple(plain(x[c]) for c in cols) for x in rows) == sorted(tuple(plain(x[c]) for c in cols) for x in want)
