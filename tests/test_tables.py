"""Tables, datasets, records, sources and sinks against small known results."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import datasets as D
from stratalens.operators import records as R
from stratalens.operators import tables as T
from stratalens.sources import readers, sinks


@pytest.fixture(scope="module")
def three(spark):
    a = spark.createDataFrame([(f"s{i}", i, f"img{i}", 1.5 * i) for i in range(5)], "id string, label int, image string, e0 double")
    b = spark.createDataFrame([(f"s{i}", 2.5 * i) for i in range(5)], "id string, e1 double")
    c = spark.createDataFrame([(f"s{i}", 3.5 * i, i % 2 == 0) for i in range(6)], "id string, e2 double, m boolean")
    return a, b, c


def test_three_tables(three):
    assert T.join_tables(three, on="id").count() == 5
    outer = T.join_tables(three, on="id", how="outer")
    filled = T.fill_and_cast(outer, {"image": {"default": "No image"}, "e1": {"type": "int", "default": 0}})
    last = filled.where("id = 's5'").first()
    assert outer.count() == 6 and last.image == "No image" and last.e1 == 0 and dict(filled.dtypes)["e1"] == "int"
    grouped = T.group_columns(outer, {"ehr": ["e0", "e1", "e2"]}).where("id = 's2'").first()
    assert grouped.ehr == [3.0, 5.0, 7.0]


def test_join_details(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, v string")
    rows = T.join_tables([a, b], on="k", how="outer", indicator="side").collect()
    assert {(r.k, r.v_x, r.v_y, r.side) for r in rows} == {(1, "x", None, "left_only"), (None, "y", "z", "both"), (2, None, "w", "right_only")}
    assert T.select_rows(spark.range(10).withColumnRenamed("id", "i"), "i", [7, (1, 3)]).count() == 3


def parts(df, key="x"):
    out = {}
    for r in df.collect():
        out.setdefault(r.part, []).append((r["position"] if "position" in df.columns else r[key], r[key]))
    return [[x for _, x in sorted(out[p])] for p in sorted(out)]


def test_partitions(spark):
    def rows(n):
        return D.row_index(spark.createDataFrame([(i,) for i in range(1, n + 1)], "x int"), ["x"])

    assert parts(D.partition_strided(rows(5), 2)) == [[1, 3, 5], [2, 4]]
    assert parts(D.partition_even(rows(5), 2, 5)) == [[1, 3, 5], [2, 4, 1]]
    assert parts(D.partition_even(rows(5), 2, 5, drop_last=True)) == [[1, 3], [2, 4]]
    assert parts(D.partition_ratios(rows(5), [3, 2], 5)) == [[1, 2, 3], [4, 5]]
    assert parts(D.partition_ratios(rows(5), [2, 1], 5)) == [[1, 2, 3], [4, 5]]
    assert sorted(r.x for r in D.resample(rows(5), 2.5, 5).collect()) == sorted([1, 2, 3, 4, 5] * 2 + [1, 2, 3])


def test_row_index_by_ranges(spark):
    df = spark.createDataFrame([(int(x), f"n{x}") for x in np.random.default_rng(0).permutation(500)], "x long, s string")
    assert all(r.x == r.row_idx for r in D.row_index(df, ["x"]).collect())
    by_name = sorted((r.s, r.row_idx) for r in D.row_index(df, ["s"]).collect())
    assert [i for _, i in by_name] == list(range(500))


def test_weighted_draws(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([1, 0, 3, 6])], "k long, w double")
    got = sorted((r.draw, r.k) for r in D.weighted_draws(df, "w", [0.05, 0.15, 0.39, 0.99], "k", 2).collect())
    assert got == [(0, 0), (1, 2), (2, 2), (3, 3)]


def test_records(spark):
    df = spark.createDataFrame([(1, (2, "a"), [1.0, 2.0])], "k int, s struct<x:int,y:string>, v array<double>")
    assert R.flatten_sub_keys(df, "s", ["x"], prefix="s").columns == ["k", "v", "s_x"]
    assert dict(R.delete_items(df, ["s.x", "k"]).dtypes) == {"s": "struct<y:string>", "v": "array<double>"}
    assert R.concat_items(df, ["v", "k"], "all").first()["all"] == [1.0, 2.0, 1.0]
    labels = spark.createDataFrame([(1,), (2,), (None,)], "l int")
    assert [r[0] for r in labels.select(R.map_labels(F.col("l"), {1: 2, 2: 1})).collect()] == [2, 1, None]
    with pytest.raises(ValueError):
        R.copy_items(df, ["k"], 2, ["only"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"name": "x", "training": [{"image": "./a.npy", "label": 1}, {"image": "/abs/b.npy", "label": 2}], "test": ["c.npy"]}))
    path = str(tmp_path / "list.json")
    assert sorted(r.image for r in readers.load_datalist(spark, path, base="/base").collect()) == ["/abs/b.npy", "/base/a.npy"]
    assert readers.load_datalist(spark, path, "test", "/base").first().image == "/base/c.npy"
    with pytest.raises(KeyError):
        readers.datalist_properties(spark, path, ["none"])
    (tmp_path / "arrays").mkdir()
    np.save(tmp_path / "arrays/a.npy", np.arange(6).reshape(2, 3))
    np.savez(tmp_path / "arrays/b.npz", p=np.ones(2), q=np.zeros((1, 1)))
    (tmp_path / "arrays/c.pgm").write_bytes(b"P5 2 2 255 " + bytes([1, 2, 3, 4]))
    (tmp_path / "arrays/d.npy").write_bytes(b"broken")
    got = {(r.path.rsplit("/", 1)[1], r.name): (r["shape"], r.data) for r in readers.read_arrays(spark, str(tmp_path / "arrays")).collect()}
    assert got["a.npy", "data"] == ([2, 3], [0.0, 1, 2, 3, 4, 5]) and got["b.npz", "p"] == ([2], [1.0, 1.0])
    assert got["c.pgm", "data"][1] == [1.0, 2, 3, 4] and got["d.npy", "data"] == (None, None)
    df = spark.createDataFrame([("k1", [1.0, 2.0])], "name string, v array<double>")
    sinks.save_csv(df, str(tmp_path / "csv"), "name", "v", "\t")
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == "k1\t1.0\t2.0"
    one = readers.cached(spark.range(5), f"file://{tmp_path}/cache", "step")
    assert one.count() == 5 and readers.cached(spark.range(5), f"file://{tmp_path}/cache", "step").count() == 5
    # An input that was written anew under the same names gives a new table.
    (tmp_path / "in").mkdir()
    read = lambda: spark.read.schema("x int").csv(f"file://{tmp_path}/in/a.csv")
    (tmp_path / "in" / "a.csv").write_text("1\n")
    assert readers.cached(read(), f"file://{tmp_path}/cache", "s").count() == 1
    (tmp_path / "in" / "a.csv").write_text("1\n2\n")
    assert readers.cached(read(), f"file://{tmp_path}/cache", "s").count() == 2 and readers.cached(read(), f"file://{tmp_path}/cache", "s").count() == 2
    spark.dataSource.register(readers.FrameSource)
    assert spark.read.format("frames").option("frames", 250).load().count() == 250
    names = spark.createDataFrame([("/d/img.nii.gz",)], "p string").select(sinks.file_name(F.col("p"), "seg")).first()[0]
    assert names == "img/img_seg.nii.gz"


@pytest.mark.parametrize("n", [0, 3, 6, 8])
def test_sampler_ranks_have_one_size(spark, tmp_path, n):
    from stratalens.plans.catalogue import QUERIES

    spark.createDataFrame([(i,) for i in range(n)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    rows = sorted(QUERIES["distributed_sampler"](spark, str(tmp_path)).collect(), key=lambda r: r.rank)
    assert [r.rank for r in rows] == [k for k in range(4) for _ in range(-(-n // 4))]
    assert {r.event_id for r in rows} == set(range(n))
    if n == 6:  # the first two in shuffled order start over
        first = sorted({(r.shuffle_key, r.event_id) for r in rows})[:2]
        assert [sum(r.event_id == i for r in rows) for _, i in first] == [2, 2]


def test_streams_that_grow_leave_the_driver(spark, data):
    from stratalens.plans.catalogue import QUERIES

    for name in ("stream_chunk_counts", "stream_session"):
        df = QUERIES[name](spark, data)
        files = df.inputFiles()
        assert files and all("/stratalens/" in f and f.endswith(".parquet") for f in files) and df.count()
