"""Surface distances of masks in any number of dimensions: edges, nearest distances, Hausdorff distance, average distance, surface Dice.

Masks are dense arrays (``Nd``) of one record; everything is an expression of that record's row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions.nd import Nd, product, ravel_index, unravel_index


def edges(mask: Nd) -> Column:
    """Coordinates (arrays of doubles) of the cells of a 0/1 mask that have a cell outside the mask, or the array's end, beside them along an axis."""
    shape = mask.shape
    total = product(shape)
    value = lambda at: F.element_at(mask.data, (ravel_index(at, shape) + 1).cast("int")) != 0

    def cell(i: Column) -> Column:
        at = unravel_index(i, shape)
        covered = []
        for k, n in enumerate(shape):
            for step in (-1, 1):
                there = [c + step if j == k else c for j, c in enumerate(at)]
                covered.append((there[k] >= 0) & (there[k] < n) & F.when((there[k] >= 0) & (there[k] < n), value(there)).otherwise(F.lit(False)))
        return F.when(value(at) & ~reduce(Column.__and__, covered), F.array(*[c.cast("double") for c in at]))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(total) - 1), cell), lambda p: p.isNotNull())


def nearest(points: Column, others: Column, spacing: Sequence[float], metric: str = "euclidean") -> Column:
    """Distance of each point to the nearest of the others; infinite if there are none. Chessboard and taxicab distances count cells."""
    dims = range(len(spacing))

    def distance(a: Column, b: Column) -> Column:
        d = [F.abs(a[k] - b[k]) for k in dims]
        if metric == "chessboard":
            return F.greatest(*d) if len(d) > 1 else d[0]
        if metric == "taxicab":
            return reduce(Column.__add__, d)
        return F.sqrt(reduce(Column.__add__, [x * s * x * s for x, s in zip(d, map(float, spacing), strict=True)]))

    return F.transform(points, lambda a: F.coalesce(F.array_min(F.transform(others, lambda b: distance(a, b))), F.lit(float("inf"))))


def array_percentile(values: Column, percent: float) -> Column:
    """Percentile of an array with linear interpolation; NULL without values."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * (percent / 100.0)
    lo, hi = F.element_at(s, (F.floor(at) + 1).cast("int")), F.element_at(s, (F.ceil(at) + 1).cast("int"))
    return F.when(F.size(s) > 0, F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))))


def hausdorff(there: Column, back: Column, percent: float | None = None, directed: bool = False) -> Column:
    """From the distances of each surface to the other: the greatest, or a percentile, of both (or of the first alone)."""
    one = (lambda d: array_percentile(d, percent)) if percent is not None else F.array_max
    return one(there) if directed else F.greatest(one(there), one(back))


def average_distance(there: Column, back: Column, symmetric: bool = False) -> Column:
    d = F.concat(there, back) if symmetric else there
    return F.when(F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda a, b: a + b) / F.size(d))


def surface_dice(there: Column, back: Column, tolerance: float) -> Column:
    """Share of both surfaces that lies within a tolerance of the other; NULL if neither has any."""
    both = F.concat(there, back)
    return F.when(F.size(both) > 0, F.size(F.filter(both, lambda d: d <= tolerance)) / F.size(both))


def spacing_of(spacing: float | Sequence[float] | None, dims: int) -> list[float]:
    """One spacing for each axis."""
    if spacing is None:
        return [1.0] * dims
    if isinstance(spacing, (int, float)):
        return [float(spacing)] * dims
    out = [float(s) for s in spacing]
    if len(out) == 1:
        out *= dims
    if len(out) != dims or any(math.isnan(s) or s <= 0 for s in out):
        raise ValueError("one positive spacing, or one for each axis")
    return out
