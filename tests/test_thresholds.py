"""Thresholds on stored 32-bit values, held against SQL where a value is the threshold."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from stratalens.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", ["label_transforms", "classes_to_indices", "extreme_points", "label_discrepancy", "crop_centers", "crop_centers_by_class", "surfaces_2d", "surfaces_3d", "probability_peaks"])
def test_values_equal_to_a_threshold(spark, tmp_path, name):
    at = [np.float32(x) for x in (-0.1, -0.02, 0.03, 0.05, 0.1, 0.15, 0.2, 0.25)]
    rng = np.random.default_rng(9)
    rows = [(i, [float(at[k]) for k in rng.integers(0, 8, 64)], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(SQL[name])
    cols = sorted(df.columns)
    plain = lambda v: v if isinstance(v, (str, type(None))) else float(v) + 0.0
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert rows and sorted(map(str, rows)) == sorted(str(tuple(plain(dict(zip(want.columns, x, strict=True))[c]) for c in cols)) for x in want.fetchall())
