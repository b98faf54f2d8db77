"""Affine helpers against their definitions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import affines as AF
from stratalens.functions.nd import Nd


def test_matrices():
    assert np.allclose(AF.rotation(np.pi / 2) @ [1, 0, 1], [0, 1, 1])
    assert np.allclose(AF.rotation([0, 0, np.pi / 2]) @ [1, 0, 0, 1], [0, 1, 0, 1])
    assert np.allclose(AF.rotation([np.pi / 2, 0, 0]) @ [0, 1, 0, 1], [0, 0, 1, 1])
    r = AF.rotation([0.3, -0.4, 0.5])
    assert np.allclose(r[:3, :3] @ r[:3, :3].T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    assert AF.shearing([2, 3]).tolist() == [[1, 2, 0], [3, 1, 0], [0, 0, 1]]
    assert (AF.translation([1, 2]) @ AF.scaling([3, 4]) @ [1, 1, 1]).tolist() == [4, 6, 1]
    assert AF.to_square(np.diag([2, 3, 4, 1]), 2).tolist() == np.diag([2, 3, 1]).tolist()
    assert AF.to_square(np.diag([2, 3, 1]), 3).tolist() == np.diag([2, 3, 1, 1]).tolist()
    assert AF.divisible_size([5, 8, 3], [4, 4, 0]) == [8, 8, 3] and AF.valid_patch([5, 8], [9, 0]) == [5, 8]


def test_zoom_and_resize():
    m = AF.rotation([0.1, 0.2, 0.3]) @ AF.scaling([1, 2, 3])
    z = AF.zoomed(m, (2, 2, 2), diagonal=False)
    assert np.allclose(np.sqrt((z[:3, :3] ** 2).sum(axis=0)), 2) and np.allclose(z[:3, 0] / 2, m[:3, 0])
    assert AF.zoomed(m, (2,)).tolist() == np.diag([2, 2, 3, 1]).astype(float).tolist() or np.allclose(AF.zoomed(m, (2,)), np.diag([2, 2, 3, 1]))
    r = AF.resized([8, 8], [4, 16])
    assert np.allclose(r @ [1.5, 7.5, 1], [3.5, 3.5, 1])
    size, offset = AF.box_in((10, 10, 10), np.diag([1, 1, 1, 1.0]), np.diag([2, 2, 2, 1.0]))
    assert size == [5, 5, 5] or size == [6, 6, 6]
    assert np.allclose(offset, 0)


def test_grids():
    g = AF.grid((3, 4), (2, 1))
    assert g.shape == (3, 3, 4) and g[0, :, 0].tolist() == [-2, 0, 2] and np.allclose(g[1, 0], [-1.5, -0.5, 0.5, 1.5])
    c = AF.control_grid((10, 9), (4, 4), homogeneous=False)
    assert all((c[k].max() - c[k].min()) >= n - 1 for k, n in enumerate((10, 9)))


@pytest.mark.parametrize("codes", ["RAS", "LPS", "SLA", "PIR"])
def test_orientation(spark, codes):
    a = np.arange(24.0).reshape(2, 3, 4)
    order, flipped = AF.reorientation("RAS", codes)
    want = np.transpose(a, order)
    want = np.flip(want, [i for i, f in enumerate(flipped) if f])
    x = Nd(F.col("v"), (2, 3, 4))
    y = AF.oriented(x, "RAS", codes)
    got = spark.createDataFrame([(a.ravel().tolist(),)], "v array<double>").select(y.data.alias("v")).first().v
    assert np.array(got).reshape(want.shape).tolist() == want.tolist()
    m = AF.oriented_affine(np.eye(4), a.shape, "RAS", codes)
    assert AF.axis_codes(m) == codes
    for at in itertools.product(*map(range, want.shape)):  # the same place in the world holds the same value
        world = m @ [*at, 1]
        assert a[tuple(int(round(w)) for w in world[:3])] == want[at]
