"""Resampling against numpy, traces and their inverse."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import resampling as R
from stratalens.operators import traced as T


def plain(a, m, size, mode, fill=0.0, border=False, moved=None):
    out = np.zeros(size)
    for at in itertools.product(*map(range, size)):
        x = m[:, :-1] @ np.array(at, float) + m[:, -1]
        if moved is not None:
            x = x + moved[(slice(None), *at)]

        def read(p):
            if border:
                p = [min(max(q, 0), n - 1) for q, n in zip(p, a.shape, strict=True)]
            return a[tuple(p)] if all(0 <= q < n for q, n in zip(p, a.shape, strict=True)) else fill

        if mode == "nearest":
            out[at] = read([int(np.floor(q + 0.5)) for q in x])
        else:
            low = np.floor(x).astype(int)
            for c in itertools.product((0, 1), repeat=a.ndim):
                w = np.prod([(q - lo) if k else 1 - (q - lo) for q, lo, k in zip(x, low, c, strict=True)])
                out[at] += w * read(low + np.array(c)) if w > 0 else 0
    return out


@pytest.mark.parametrize(("dims", "mode", "border"), [(1, "linear", False), (2, "nearest", True), (2, "linear", False), (3, "linear", True), (3, "nearest", False)])
def test_gather_and_matrices(spark, dims, mode, border):
    rng = np.random.default_rng(dims)
    shape, size = (5, 4, 3)[:dims], (4, 6, 2)[:dims]
    rows, want = [], []
    for i in range(4):
        a, m, k = rng.random(shape), rng.normal(0, 1, (dims, dims + 1)), rng.normal(0, 1, (dims, dims + 1))
        moved = rng.normal(0, 1, (dims, *size))
        rows.append((i, a.ravel().tolist(), m.ravel().tolist(), k.ravel().tolist(), moved.ravel().tolist()))
        full = lambda x: np.vstack([x, [0] * dims + [1]])  # noqa: E731, B023
        want.append(((full(m) @ full(k))[:dims], np.linalg.inv(full(m))[:dims], plain(a, m, size, mode, 7.0, border, moved)))
    df = spark.createDataFrame(rows, "i int, a array<double>, m array<double>, k array<double>, d array<double>")
    to = lambda s: F.array(*map(F.lit, s))
    got = df.select(R.compose(F.col("m"), F.col("k"), dims).alias("c"), R.inverse(F.col("m"), dims).alias("n"), R.gather(F.col("a"), to(shape), F.col("m"), to(size), dims, mode, 7.0, border, F.col("d")).alias("g"), "i").orderBy("i").collect()
    for r, (c, n, g) in zip(got, want, strict=True):
        assert np.allclose(r.c, c.ravel()) and np.allclose(r.n, n.ravel()) and np.allclose(r.g, g.ravel())
    assert df.select(R.inverse(R.matrix([[0.0] * (dims + 1)] * dims), dims).alias("n")).first().n is None


def test_a_lazy_chain_gathers_once(spark):
    df = spark.createDataFrame([(k, [float(x) for x in range(12)], [3, 4]) for k in range(5)], "k long, data array<double>, shape array<int>")
    steps = [T.flip(0.5, 1), T.rotate90(3, 2), T.translate((1, 0))]
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("sequence(0")
    lazy, eager = T.apply_lazily(df, steps, "k", 2), T.apply(df, steps, "k", 2)
    assert plan(lazy) == 1 and plan(eager) == 3
    cols = ["k", "data", "shape"]
    assert sorted(lazy.select(*cols).collect()) == sorted(eager.select(*cols).collect())
    assert {r.trace[0].step for r in lazy.collect()} == {"flip+rotate90+translate"}
    with pytest.raises(ValueError, match="nearest or linear"):
        T.apply_lazily(df, steps, "k", 2, "cubic")


def test_inverse_restores_place_and_shape(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.random(int(np.prod(s))).tolist(), s) for k, s in enumerate([[3, 4], [6, 2], [1, 1], [5, 5], [0, 3]])]
    df = spark.createDataFrame(rows, "k long, data array<double>, shape array<int>")
    steps = [T.flip(0.5, 1), T.rotate90(3, 2), T.pad(2, 3), T.zoom(1.0, 2.0, 4)]
    there = T.apply(df, steps, "k", 2)
    assert [[t.step for t in r.trace] for r in there.collect()] == [["flip", "rotate90", "pad", "zoom"]] * 5
    back = {r.k: (r.data, r.shape, r.trace) for r in T.invert(there, 2).collect()}
    assert back == {k: (a, s, []) for k, a, s in rows}
    # Made from other rows: a row without an image stays as it is, null arrays stay null.
    made = there.select("k", "data", "shape").unionByName(spark.createDataFrame([(99, [1.0], [1, 1]), (98, None, None)], "k long, data array<double>, shape array<int>"))
    put = {r.k: r.data for r in T.invert_with(made, there, ["k"], 2).collect()}
    assert put == {k: a for k, a, _ in rows} | {99: [1.0], 98: None}


def test_a_crop_comes_back_to_its_place(spark):
    a = np.arange(1.0, 31).reshape(5, 6)
    df = spark.createDataFrame([(k, a.ravel().tolist(), [5, 6]) for k in range(20)], "k long, data array<double>, shape array<int>")
    places = set()
    for r in T.invert(T.apply(df, [T.crop((3, 9), 5), T.rotate90(3, 6)], "k", 2), 2, fill=-1.0).collect():
        back = np.array(r.data).reshape(r.shape)
        rows = np.flatnonzero((back != -1).any(axis=1))
        assert len(rows) == 3 and (back[rows] == a[rows]).all()
        places.add(int(rows[0]))
    assert places == {0, 1, 2}


def test_rotation_keeps_the_middle(spark):
    a = np.zeros((5, 5))
    a[2, 2], a[2, 4] = 5, 1
    df = spark.createDataFrame([(1, a.ravel().tolist(), [5, 5])], "k long, data array<double>, shape array<int>")
    for mode in ("nearest", "linear"):
        turned = np.array(T.apply_lazily(df, [T.rotate(np.pi / 2, np.pi / 2 + 1e-12)], "k", 2, mode).first().data).reshape(5, 5)
        assert turned[2, 2] == pytest.approx(5) and sorted(turned.ravel())[-2:] == pytest.approx([1, 5]) and turned[0, 2] + turned[4, 2] == pytest.approx(1)


def test_rows_gathered_together_are_those_of_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.random(12).tolist(), [3, 4], rng.normal(0, 1, 6).tolist(), [int(x) for x in rng.integers(0, 5, 2)]) for k in range(40)]
    rows += [(40, None, [3, 4], rows[0][3], [2, 2]), (41, [1.0, None, 3.0, 4.0], [2, 2], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [3, 2]), (42, [], [0, 3], rows[0][3], [2, 1]), (43, [1.0] * 12, [3, 4], [0.0] * 6, [2, 2]), (44, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a array<double>, s array<int>, m array<double>, n array<int>").repartition(3)
    args = [F.col(c) for c in "asmn"]
    for r in df.select("k", R.gather(*args, 2, fill=7.0).alias("x"), R.gather_rows(*args, 2, 7.0).alias("y")).collect():
        assert r.x == r.y, r.k
    back = lambda c: R.gather(c, F.col("s"), R.inverse(F.col("m"), 2), F.col("n"), 2, fill=7.0)
    for r in df.where("k <> 44").select("k", back(F.col("a")).alias("x"), R.restore(F.col("a"), F.col("s"), F.array("m"), F.array("n"), 2, 7.0).alias("y")).collect():
        assert r.x == r.y, r.k
