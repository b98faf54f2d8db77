"""Fast transforms against numpy's, wavelets against convolution."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import fourier as FT


def table(spark, a):
    return spark.createDataFrame([(a.real.ravel().tolist(), a.imag.ravel().tolist())], "re array<double>, im array<double>").select(F.zip_with("re", "im", lambda x, y: F.struct(x.alias("re"), y.alias("im"))).alias("z"))


def values(row, shape):
    return np.array([z.re + 1j * z.im for z in row]).reshape(shape)


@pytest.mark.parametrize(("shape", "axes"), [((1,), None), ((7,), None), ((60,), None), ((6, 5), None), ((3, 4, 2), (0, -1)), ((4096,), None)])
def test_transform_and_back(spark, shape, axes):
    rng = np.random.default_rng(0)
    a = rng.normal(size=shape) + 1j * rng.normal(size=shape)
    there = table(spark, a).select(FT.fftn(F.col("z"), shape, axes).alias("z"))
    assert np.allclose(values(there.first().z, shape), np.fft.fftn(a, axes=axes, norm="ortho"))
    back = there.select(FT.fftn(F.col("z"), shape, axes, inverse=True).alias("z")) if a.size < 100 else None
    if back is not None:
        assert np.allclose(values(back.first().z, shape), a)
        plain = table(spark, a).select(FT.fftn(F.col("z"), shape, axes, True, False).alias("z"), FT.centered(F.col("z"), shape, axes).alias("c")).first()
        assert np.allclose(values(plain.z, shape), np.fft.ifftn(a, axes=axes))
        assert np.allclose(values(plain.c, shape), np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(a, axes), axes=axes, norm="ortho"), axes))


def test_factors():
    assert [FT.factors(n) for n in (1, 2, 8, 60, 97, 1920)] == [[], [2], [4, 2], [4, 3, 5], [97], [4, 4, 4, 2, 3, 5]]


def test_wavelets_are_convolutions(spark):
    rng = np.random.default_rng(1)
    x, widths = rng.normal(size=50), (1.0, 3.0)
    df = spark.createDataFrame([(x.tolist(),)], "v array<double>")
    got = df.select(FT.wavelets(F.col("v"), 50, widths).alias("c")).first().c
    for w, row in zip(widths, got, strict=True):
        bank = np.array(FT.mexican_hat(w))
        assert np.sum(bank**2) == pytest.approx(1, abs=2e-2)  # sampled
        full = np.convolve(x, bank)
        assert np.allclose(row, full[len(bank) // 2 :][:50])


def test_wavelets_of_short_absent_and_broken_signals(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>").coalesce(1)
    got = {r.id: r.c for r in df.select("id", FT.wavelets(F.col("v"), 8, (1.0, 2.5)).alias("c")).collect()}
    for k, w in enumerate((1.0, 2.5)):
        bank = np.array(FT.mexican_hat(w))
        want = np.convolve([1.0, 2.0, 0, 0, 0, 0, 0, 0], bank)[len(bank) // 2 :][:8]
        assert np.allclose(got[0][k], want) and got[2][k] == [None] * 8 and np.allclose(got[3][k], 0)
    assert got[1] is None
