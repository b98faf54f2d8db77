"""Stain separation of pixel tables: rows of image columns (``by``) and three colour values from 0 to 255.

Absorbance is -ln((value + 1, at most ``light``) / light). The two stains of an image are the extreme
directions, by exact percentiles of the angle, in the plane of the two largest principal axes of the
absorbances above ``faint``. Sums, angles and least squares run in the JVM, percentiles by ranges; only 3 x 3
matrices, one an image, meet numpy. A principal axis points to where its components sum to no less than 0,
so all angles lie in one half turn.

Pixels with a null or values outside 0 to 255 are left out. An image without two pixels above ``faint`` has no stains.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.ordered import percentiles
from stratalens.storage import written

RGB = ("r", "g", "b")
# Absorbances of the two stains (rows are colours) and their concentrations in a reference slide.
TARGET = ((0.5626, 0.2159), (0.7201, 0.8012), (0.4062, 0.5581))
CONCENTRATIONS = (1.9705, 1.0308)


def absorbance(value: Column, light: float = 240.0) -> Column:
    return -F.log(F.least(value.cast("double") + 1, F.lit(float(light))) / float(light))


def _valid(pixels: DataFrame, rgb: Sequence[str]) -> DataFrame:
    return pixels.where(reduce(Column.__and__, [F.col(c).between(0, 255) for c in rgb]))


def _same(by: Sequence[str], prefix: str) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by], F.lit(True))


def _per_image(df: DataFrame, by: Sequence[str], column: str, out: Sequence[str], f) -> DataFrame:
    """An array column of each image through a numpy function to number columns."""
    kinds = dict(df.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [f(np.array(x, float)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *[pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(len(out))]], [*by, *out])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"{c} double" for c in out)]))


def principal_plane(cov: np.ndarray) -> np.ndarray:
    """The second and the first principal axis of six covariances (rr, rg, rb, gg, gb, bb), end to end."""
    a, b, c, d, e, f = cov
    _, v = np.linalg.eigh(np.array([[a, b, c], [b, d, e], [c, e, f]]))
    v = v[:, 1:]
    return (v * np.where(v.sum(axis=0) < 0, -1, 1)).T.ravel()


def extract_stains(pixels: DataFrame, by: Sequence[str], rgb: Sequence[str] = RGB, light: float = 240.0, alpha: float = 1.0, faint: float = 0.15) -> DataFrame:
    """(by, h_r, h_g, h_b, e_r, e_g, e_b): the absorbance directions of both stains; the one with more of the first colour is h."""
    od = _valid(pixels, rgb).select(*by, *[absorbance(F.col(c), light).alias(f"__{k}") for k, c in enumerate(rgb)])
    od = od.where(" and ".join(f"__{k} > {float(faint)!r}" for k in range(3)))
    cov = od.groupBy(*by).agg(F.array(*[F.covar_samp(f"__{i}", f"__{j}") for i in range(3) for j in range(i, 3)]).alias("c"), F.count("*").alias("n")).where("n > 1")
    axes = [f"__a{k}" for k in range(6)]
    planes = _per_image(cov, by, "c", axes, principal_plane).withColumnsRenamed({c: f"__k_{c}" for c in by})
    planes = written(planes, "planes")
    dot = lambda at: reduce(Column.__add__, [F.col(f"__{k}") * F.col(f"__a{at + k}") for k in range(3)])
    angles = od.join(planes, _same(by, "__k_")).select(*by, F.atan2(dot(3), dot(0)).alias("__phi"))
    ends = percentiles(angles, "__phi", by, [alpha, 100 - alpha])
    low, high = ([F.cos(F.col("p")[i]) * F.col(f"__a{k}") + F.sin(F.col("p")[i]) * F.col(f"__a{3 + k}") for k in range(3)] for i in range(2))
    out = ends.join(planes, _same(by, "__k_")).select(*by, F.array(*low).alias("__low"), F.array(*high).alias("__high"))
    first = F.col("__low")[0] > F.col("__high")[0]
    pick = lambda k, other: F.when(first != F.lit(other), F.col("__low")[k]).otherwise(F.col("__high")[k])
    return out.select(*by, *[pick(k, other).alias(f"{s}_{c}") for s, other in (("h", False), ("e", True)) for k, c in enumerate("rgb")])


def _least_squares(stains: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(stains.reshape(2, 3).T).ravel()


def concentrations(pixels: DataFrame, stains: DataFrame, by: Sequence[str], rgb: Sequence[str] = RGB, light: float = 240.0) -> DataFrame:
    """The valid pixels of images with stains, with ``h`` and ``e``: how much of each stain explains their absorbance best."""
    names = [f"{s}_{c}" for s in "he" for c in "rgb"]
    solve = [f"__p{k}" for k in range(6)]
    per = _per_image(stains.select(*by, F.array(*names).alias("c")), by, "c", solve, _least_squares).withColumnsRenamed({c: f"__k_{c}" for c in by})
    rows = _valid(pixels, rgb).join(per, _same(by, "__k_"))
    od = [absorbance(F.col(c), light) for c in rgb]
    amount = lambda s: reduce(Column.__add__, [od[k] * F.col(f"__p{3 * s + k}") for k in range(3)])
    return rows.withColumns({"h": amount(0), "e": amount(1)}).select(*pixels.columns, "h", "e")


def normalize_stains(pixels: DataFrame, by: Sequence[str], rgb: Sequence[str] = RGB, light: float = 240.0, alpha: float = 1.0, faint: float = 0.15, target: Sequence[Sequence[float]] = TARGET, most: Sequence[float] = CONCENTRATIONS, whole: bool = True) -> DataFrame:
    """The valid pixels in the colours that the target stains give: concentrations scaled so that their 99th percentile is the reference's. ``whole`` cuts to whole numbers, those over 255 to 254."""
    amounts = written(concentrations(pixels, extract_stains(pixels, by, rgb, light, alpha, faint), by, rgb, light), "stains")
    tops = [percentiles(amounts, c, by, [99.0]).select(*[F.col(k).alias(f"__{c}_{k}") for k in by], F.col("p")[0].alias(f"__top_{c}")) for c in "he"]
    for c, top in zip("he", tops, strict=True):
        amounts = amounts.join(top, _same(by, f"__{c}_"))
    h, e = (F.col(c) / (F.col(f"__top_{c}") / m) for c, m in zip("he", most, strict=True))
    colour = [float(light) * F.exp(-(h * float(t[0]) + e * float(t[1]))) for t in target]
    if whole:
        colour = [F.floor(F.when(x > 255, F.lit(254.0)).otherwise(x)).cast("int") for x in colour]
    made = dict(zip(rgb, colour, strict=True))
    return amounts.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in pixels.columns])
