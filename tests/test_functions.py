"""Arrays, intensities, signals, tensors and pipelines."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import arrays as A
from stratalens.functions import intensity as I
from stratalens.functions import signals as S
from stratalens.functions import tensors as X
from stratalens.plans import pipeline as PL


def one(spark, values, f):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(f(F.col("v"))).first()[0]


def test_arrays(spark):
    v = [float(x) for x in (3, -1, 7, 7, 0)]
    assert one(spark, v, A.argmax) == 2 and one(spark, v, A.argmin) == 1
    assert one(spark, v, lambda c: A.pad_to(c, 8)) == [0.0, *v, 0.0, 0.0] and one(spark, v, lambda c: A.pad_to(c, 8, symmetric=False)) == [*v, 0.0, 0.0, 0.0]
    assert one(spark, v, lambda c: A.crop(c, -2, 2)) == v[:2] and one(spark, v, lambda c: A.center_crop(c, 3)) == v[1:4]
    assert one(spark, v, lambda c: A.resize_with_pad_or_crop(c, 7)) == [0.0, *v, 0.0]
    assert one(spark, v, lambda c: A.roll(c, 2)) == list(np.roll(v, 2)) and one(spark, v, A.cumsum) == list(np.cumsum(v))
    assert one(spark, v, A.softmax) == pytest.approx(list(np.exp(v) / np.exp(v).sum()))
    assert tuple(one(spark, v, lambda c: A.foreground_box(c, 1.0))) == (0, 4) and tuple(one(spark, [0.0], A.foreground_box)) == (0, 0)
    assert one(spark, v, lambda c: S.paste(c, [9.0, 9.0], 4)) == [*v[:4], 9.0]


def test_intensity(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 5.0), ("b", 0.0), (None, 3.0)], "g string, v double")
    got = {(r.g, r.v): r.s for r in I.scale_minmax(df, "v", ["g"], "s", 1.0, 2.0).collect()}
    assert got["a", 2.0] == 2.0 and got["b", 5.0] == 2.0 and got["b", 1.0] == pytest.approx(1.2) and got[None, 3.0] == 3.0
    z = {(r.g, r.v): r.z for r in I.normalize(df, "v", ["g"], "z", nonzero=True).collect()}
    assert z["a", 2.0] == 0.0 and z["b", 0.0] == 0.0 and z["b", 5.0] == pytest.approx(1.0)
    bins = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.1, -0.1)], "v double").select(I.bin_of(F.col("v"), 0.0, 1.0, 4)).collect()
    assert [r[0] for r in bins] == [0, 2, 3, None, None]


def test_savitzky_golay_weights():
    assert S.savitzky_golay(2, 2) == pytest.approx([-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35])


def test_tensor_column(spark):
    df = spark.createDataFrame([(1, [2, 3], [float(x) for x in range(6)]), (2, None, None)], "id int, shape array<int>, data array<double>")
    got = {r.id: r for r in X.apply(df, [X.flip([1]), X.transpose([1, 0]), X.pad_to([3, 4])], "id").collect()}
    want = X.pad_to([3, 4])(np.flip(np.arange(6).reshape(2, 3), 1).T)
    assert got[1]["shape"] == [3, 4] and got[1].data == want.ravel().tolist() and got[2].data is None


def test_tensor_kernels():
    rng = np.random.default_rng(0)
    a, mask = rng.random((7, 8)), rng.random((9, 9)) > 0.5
    assert np.allclose(X.affine(np.eye(3))(a), a) and np.allclose(X.resize((7, 8))(a), a) and np.allclose(X.rotate(0.0)(a), a)
    assert np.allclose(X.rotate(np.pi / 2)(a[:, :7]), np.rot90(a[:, :7], 1), atol=1e-9) or np.allclose(X.rotate(np.pi / 2)(a[:, :7]), np.rot90(a[:, :7], -1), atol=1e-9)
    assert np.allclose(X.warp(np.zeros((2, 7, 8)))(a), a)
    assert np.allclose(X.fft_centered(X.fft_centered(a), True).real, a) and np.allclose(X.gibbs(0.0)(a), a)
    assert X.gaussian_smooth(1.0)(np.ones((9, 9)))[4, 4] == pytest.approx(1.0, abs=1e-3)
    assert (X.median_filter(1)(np.ones((4, 4))) == 1).all() and X.divisible_pad(4)(a).shape == (8, 8)
    d = X.distance_transform(mask)
    zeros = np.argwhere(~mask)
    assert all(d[tuple(p)] == pytest.approx(np.sqrt(((zeros - p) ** 2).sum(axis=1).min())) for p in np.argwhere(mask))
    ring = np.zeros((7, 7))
    ring[1:6, 1:6], ring[3, 3] = 1, 0
    assert X.fill_holes(ring)[3, 3] == 1 and X.fill_holes(ring)[0, 0] == 0
    assert X.ssim(a, a) == pytest.approx(1.0) and X.otsu(np.array([0.0] * 50 + [1.0] * 50)) < 1.0
    assert X.spacing(np.diag([2.0, 3.0, 0.0, 1.0])).tolist() == [2.0, 3.0, 1.0]


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for p in zip(*np.nonzero(mask), strict=True):
        if not label[p]:
            n += 1
            todo = [p]
            label[p] = n
            while todo:
                x, y = todo.pop()
                for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not label[q]:
                        label[q] = n
                        todo.append(q)
    return label


def test_components_are_those_of_a_flood():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((12, 11)) > 0.45
        a, b = X.components(mask), flood(mask)
        assert len({(x, y) for x, y in zip(a.ravel(), b.ravel(), strict=True)}) == len(np.unique(b))
    two = np.array([[1, 0, 1, 1]])
    assert X.keep_largest(1)(two).tolist() == [[0, 0, 1, 1]] and X.remove_small(2)(two).tolist() == [[0, 0, 1, 1]]


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(20):
        c = rng.random((4, 6))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
        assert sum(c[i, j] for i, j in X.assign(c)) == pytest.approx(best) and len(X.assign(c.T)) == 4


def test_pipelines(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "id int, v double")
    steps = PL.Compose([PL.Linear("v", 2.0, 1.0), PL.Compose([PL.Linear("v", 0.5, -3.0)])])
    assert len(PL.fuse(PL.flatten(steps.steps))) == 1
    assert {r.v for r in steps(df).collect()} == {(2 * i + 1) * 0.5 - 3 for i in range(200)}
    assert {r.v for r in steps.inverse()(steps(df)).collect()} == set(map(float, range(200)))
    pick = PL.OneOf("v", [lambda c: c * 0, lambda c: c * 0 + 1], "id", [3, 1], seed=5)
    got = [r.v for r in pick(df).collect()]
    assert got == [r.v for r in pick(df).collect()] and 20 < sum(got) < 80
    spec = {"half": 0.5, "steps": [{"step": "linear", "column": "v", "scale": "@half"}, {"step": "where", "condition": "v > 98"}, {"step": "select", "columns": ["id"]}]}
    assert PL.from_json(json.dumps(spec))(df).count() == 3
    with pytest.raises(ValueError):
        PL.resolve("@a", {"a": "@b", "b": "@a"})


def test_random_transforms_repeat(spark):
    from stratalens.functions import random_tensors as RT

    df = spark.createDataFrame([(i, [6, 6], [float(x) for x in range(36)]) for i in range(40)], "id int, shape array<int>, data array<double>")
    chain = [RT.sometimes(RT.gaussian_noise(0.0, 0.5), 0.5), RT.in_random_order([RT.axis_flip(), RT.rotate90()]), RT.elastic(1.0, 1.0), RT.grid_distortion(), RT.coarse_dropout(2, [2, 2]), RT.crop([4, 4])]
    a = {r.id: r.data for r in RT.apply_random(df, chain, "id", 3).collect()}
    b = {r.id: r.data for r in RT.apply_random(df.repartition(7), chain, "id", 3).collect()}
    assert a == b and len({tuple(v) for v in a.values()}) == 40 and all(len(v) == 16 for v in a.values())
    assert a != {r.id: r.data for r in RT.apply_random(df, chain, "id", 4).collect()}


def test_random_kernels():
    from stratalens.functions import random_tensors as RT

    a, rng = np.arange(64.0).reshape(8, 8), np.random.default_rng(0)
    for k in (RT.rician_noise(), RT.scale_intensity(-0.1, 0.1), RT.shift_intensity(-1, 1), RT.adjust_contrast(), RT.smooth(), RT.histogram_shift(), RT.bias_field(), RT.spike(1, 2), RT.coarse_shuffle(1, [3, 3]), RT.flip([0]), RT.rotate(0.3), RT.zoom(0.8, 1.2), RT.affine(0.2, 0.1, 0.1, 1.0), RT.one_of([RT.axis_flip(), RT.rotate90()], [1, 3])):
        assert k(a, rng).shape == a.shape and np.isfinite(k(a, rng)).all()
    assert sorted(RT.coarse_shuffle(3, [3, 3])(a, rng).ravel()) == sorted(a.ravel())
    box = RT.crop_by_label([3, 3], lambda x: x > 60, 1.0)(a, rng)
    assert box.shape == (3, 3) and box.max() > 60
    assert set(np.unique(RT.cutmix(a, a + 100, rng))) <= set(a.ravel()) | set((a + 100).ravel())
    assert RT.mixup(a, a, rng) == pytest.approx(a) and RT.cutout(a, rng).min() == 0
