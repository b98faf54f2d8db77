"""Global orders, joins of tables, streams with checkpoints, and groups larger than a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.functions import random_tensors as RT
from stratalens.operators import boxes as B
from stratalens.operators import datasets as D
from stratalens.operators import ordered as O
from stratalens.operators import records as R
from stratalens.operators import tables as T
from stratalens.streaming import streams as ST


def test_positions_of_any_key(spark):
    names = [f"Customer#{k:09d}" for k in range(3000)] + [None, "a", "a"]
    df = spark.createDataFrame([(n,) for n in np.random.default_rng(0).permutation(np.array(names, object)).tolist()], "k string").repartition(7)
    got = sorted((r.row_idx, r.k) for r in D.row_index(df, ["k"]).collect())
    assert [i for i, _ in got] == list(range(len(names))) and [k for _, k in got] == sorted(names, key=lambda x: (x is not None, x or ""))
    assert D.row_index(df.limit(0), ["k"]).count() == 0
    many = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20))))  # a small table made large
    assert D.row_index(many, ["k", "n"]).agg(F.max("row_idx"), F.countDistinct("row_idx")).first() == (20 * len(names) - 1, 20 * len(names))


def test_percentiles_and_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in (None, "a", "b") for v in rng.choice([1.5, 2.25, 7.0, 9.5, 11.0], 50 if g != "b" else 1)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.p for r in O.percentiles(df, "v", ["g"], [0, 12.5, 50, 99, 100]).collect()}
    for g in (None, "a", "b"):
        want = np.percentile([v for k, v in rows if k == g and v is not None], [0, 12.5, 50, 99, 100])
        assert np.allclose(got[g], want)
    counted = df.where("v is not null").groupBy("g", "v").count()
    run = O.running_sums(counted, ["g"], [F.desc("v")], {"upto": F.col("count")}).collect()
    for r in run:
        assert r.upto == sum(k == r.g and v is not None and v >= r.v for k, v in rows)
    assert O.percentiles(df.limit(0), "v", ["g"], [50]).count() == 0


def test_joins_check_their_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "key int, v string")
    with pytest.raises(ValueError, match="share no column"):
        T.join_tables([a.select("id"), b.select("key")])
    with pytest.raises(ValueError, match="left table"):
        T.join_tables([a, b], left_on="id", right_on="key", validate="1:1")
    with pytest.raises(ValueError, match="either"):
        T.join_tables([a, b], left_on="id")
    out = T.join_tables([a, b], left_on="id", right_on="key", how="outer", validate="m:1")
    assert out.columns == ["id", "v_x", "key", "v_y"] and out.count() == 4
    assert T.join_tables([a.select("id"), b.select("key")], how="cross").count() == 6
    assert [r.id for r in T.select_rows(a, "id", [2, (0, 3)], order="o").orderBy("o", "id").collect()] == [2, 2, 1, 2, 2]
    with pytest.raises(ValueError, match="exist already"):
        R.flatten_sub_keys(a.withColumn("s", F.struct(F.lit(1).alias("v"))), "s", ["v"])


def test_rows_with_separators_stay_apart(spark):
    df = spark.createDataFrame([(0, "a\x1fb", "c"), (1, "a", "b\x1fc"), (2, None, "c"), (3, "\x00", "c"), (4, "a", "b\x1fc")], "i int, x string, y string")
    assert D.dedup_by_hash(df, ["x", "y"], "i").count() == 4


def test_groups_larger_than_a_batch():
    rows = [(g, k) for g, n in ((1, 5), (2, 5000), (3, 1), (4, 700)) for k in range(n)]
    table = pa.table({"g": [g for g, _ in rows], "k": [k for _, k in rows]})
    seen = []
    for part, ends in B.sorted_groups(iter(table.to_batches(max_chunksize=300)), ["g"]):
        start = 0
        for end in ends.tolist():
            seen.append((part.column("g")[start].as_py(), end - start))
            assert part.column("k").slice(start, end - start).to_pylist() == list(range(end - start))
            start = end
    assert seen == [(1, 5), (2, 5000), (3, 1), (4, 700)]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    each = lambda batch, number: got.extend(r.x for r in batch.collect())
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).selectExpr("id as x").coalesce(1).write.mode("append").parquet(folder)
        ST.run_available(spark.readStream.schema("x long").parquet(folder), each, checkpoint=str(tmp_path / "state"))
    assert sorted(got) == list(range(6))


def test_completion_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    # Parts that come again, before or after a key is complete, change nothing.
    for k, rows in enumerate([[(1, 0, 3), (2, 0, 1)], [(1, 1, 3), (1, 0, 3), (2, 0, 1)], [(1, 2, 3), (3, 1, 2), (3, 1, 2)], [(1, 2, 3)]]):
        spark.createDataFrame(rows, "k long, part long, want long").coalesce(1).write.parquet(f"{folder}/p={k}")
    s = spark.readStream.option("maxFilesPerTrigger", 1).schema("k long, part long, want long, p int").parquet(folder).drop("p")
    got = {r.k: (r.seen, r.complete) for r in ST.run_to_table(ST.completion(s, "k", "part", "want"), "c", "update", ["k"]).collect()}
    assert got == {1: (3, True), 2: (1, True), 3: (1, False)}


def test_state_of_completion_ends_with_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k, (key, hour) in enumerate([(1, 0), (2, 9), (3, 30), (1, 31)]):
        spark.createDataFrame([(key, 0, 2, hour)], "k long, part long, want long, h long").selectExpr("k", "part", "want", "timestamp_seconds(h * 3600) as ts").coalesce(1).write.parquet(f"{folder}/p={k}")
    s = spark.readStream.option("maxFilesPerTrigger", 1).schema("k long, part long, want long, ts timestamp, p int").parquet(folder).drop("p")
    out = ST.run_to_table(ST.completion(s, "k", "part", "want", "ts", "5 hours"), "c", "update", ["k"])
    # The key that comes again a day later begins anew: the first part was forgotten, not counted twice.
    assert {r.k: (r.seen, r.complete) for r in out.collect()} == {1: (1, False), 2: (1, False), 3: (1, False)}


def test_sessions_leave_the_state_and_a_closing_event_brings_the_last_ones_out(spark, tmp_path):
    folder, ends = str(tmp_path / "in"), str(tmp_path / "ends")
    for k, hours in enumerate([[0, 1, 5], [6, 30], [31, 60]]):
        spark.createDataFrame([(7, h) for h in hours], "user long, h long").selectExpr("user", "timestamp_seconds(h * 3600) as ts").coalesce(1).write.parquet(f"{folder}/p={k}")
    spark.createDataFrame([], "ts timestamp").write.parquet(ends)
    s = spark.readStream.option("maxFilesPerTrigger", 1).schema("user long, ts timestamp, p int").parquet(folder).drop("p")
    x = ST.sessions(ST.with_closing(s, "ts", ends), "ts", "2 hours", ["user"], late="12 hours")
    out = ST.run_to_table(x, "s", closing=lambda: ST.close(spark, "ts", "timestamp", ends))
    assert sorted((r.start.hour + 24 * (r.start.day - 1), r.n) for r in out.where("user = 7").collect()) == [(0, 2), (5, 2), (30, 2), (60, 1)]


def test_tables_written_in_a_scope_go_with_it(spark):
    import os

    from stratalens import storage

    with storage.scope():
        x = storage.written(spark.range(5), "scoped")
        with storage.scope():
            y = storage.written(x, "inner")
            assert y.count() == 5
        assert not os.path.exists(y._written.removeprefix("file://")) and x.count() == 5
    assert not os.path.exists(x._written.removeprefix("file://"))
    z = storage.written(spark.range(3), "kept")
    storage.forget(z, spark.range(1))
    assert not os.path.exists(z._written.removeprefix("file://"))


@pytest.mark.parametrize(
    "kernel",
    [RT.std_shift(-1, 1), RT.fixed_mean_scale(-0.5, 0.5, preserve_range=True), RT.gaussian_sharpen(), RT.gibbs(), RT.intensity_remap(), RT.smooth_field_contrast((3, 3)), RT.smooth_field_intensity((3, 3)), RT.smooth_deform((3, 3)), RT.low_resolution(), RT.histogram_shift()],
)
def test_drawn_transforms_keep_shape_and_repeat(kernel):
    a = np.random.default_rng(0).random((9, 8))
    x, y = (kernel(a.copy(), np.random.default_rng(5)) for _ in range(2))
    assert x.shape == a.shape and (x == y).all() and np.isfinite(x).all()


def test_drawn_crops():
    a = np.arange(72.0).reshape(9, 8)
    assert RT.scale_crop([0.5, 0.5])(a, np.random.default_rng(0)).shape == (5, 4)
    w = np.zeros((9, 8))
    w[4, 5] = 1
    assert RT.weighted_crop([3, 3], lambda _: w)(a, np.random.default_rng(0))[1, 1] == a[4, 5]


def test_gaussian_weights_are_shares_of_a_distribution():
    from stratalens.functions import tensors as X

    for sigma in (0.3, 1.0, 2.5):
        w = X.gaussian_weights(sigma)
        assert len(w) % 2 == 1 and (w == w[::-1]).all() or np.allclose(w, w[::-1])
        assert 0.999 < w.sum() <= 1.0000001


def test_record_helpers(spark):
    df = spark.createDataFrame([({"b": 1, "a": 2}, ["k=v=w", "x", "k=z"])], "m map<string,int>, p array<string>")
    r = df.select(R.sorted_map(F.col("m")).alias("m"), R.pairs_to_map(F.col("p")).alias("p"), R.label_union(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("u")).first()
    assert list(r.m) == ["a", "b"] and r.p == {"x": None, "k": "z"} and r.u == [1, 2, 3]
    assert R.remove_matching(spark.createDataFrame([(1, 2, 3)], "a_1 int, a_2 int, b int"), r"a_\d").columns == ["b"]
    assert R.unit_factor("kilometer", "meter") == 1000 and abs(R.unit_factor("foot", "inch") - 12) < 1e-12
