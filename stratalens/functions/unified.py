"""The usual functions of numeric arrays, on array columns and in the JVM; positions count from 0."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions.arrays import bind, total


def where(condition: Column, a: Column, b: Column) -> Column:
    """Element by element from a where a 0/1 array holds, else from b."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(condition, both, lambda c, s: F.when(c.cast("boolean"), s["x"]).otherwise(s["y"]))


def nonzero(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def argwhere(a: Column, test) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def argsort(a: Column, descending: bool = False) -> Column:
    """Positions in the order of values; equal values in the order of positions."""
    pairs = F.transform(a, lambda x, i: F.struct((-x if descending else x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def floor_divide(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: F.floor(x / by))


def any_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def maximum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def concatenate(*arrays: Column) -> Column:
    return F.concat(*arrays)


def stack(*arrays: Column) -> Column:
    return F.array(*arrays)


def repeat(a: Column, times: int) -> Column:
    """Each element so many times."""
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, times)))


def clip(a: Column, lo: float | None, hi: float | None) -> Column:
    def one(x: Column) -> Column:
        x = x if lo is None else F.greatest(x, F.lit(lo))
        return x if hi is None else F.least(x, F.lit(hi))

    return F.transform(a, one)


def isfinite(a: Column) -> Column:
    return F.transform(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def isnan(a: Column) -> Column:
    return F.transform(a, lambda x: F.isnan(x))


def in1d(a: Column, values: Column) -> Column:
    return F.transform(a, lambda x: F.array_contains(values, x))


def searchsorted(edges: Column, a: Column, right: bool = False) -> Column:
    """How many of the sorted edges stand before each element; with ``right`` equal ones too."""
    return F.transform(a, lambda x: F.size(F.filter(edges, lambda e: e <= x if right else e < x)))


def unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def mode(a: Column) -> Column:
    """The most frequent value, the least of equally frequent ones."""
    counted = F.transform(unique(a), lambda u: F.struct((-F.size(F.filter(a, lambda x: x == u))).alias("n"), u.alias("u")))
    return F.array_min(counted)["u"]


def median(a: Column) -> Column:
    """The middle value; of an even number the mean of the two in the middle."""
    return bind(F.array_sort(a), lambda s: (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))) / 2)


def std(a: Column, sample: bool = False) -> Column:
    mid = total(a) / F.size(a)
    return F.sqrt(bind(mid, lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / (F.size(a) - (1 if sample else 0)))


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda c: F.coalesce(c, F.lit(False)))


def is_empty(a: Column) -> Column:
    """Whether no element differs from the first."""
    return F.coalesce(F.array_max(a) == F.array_min(a), F.lit(True))


def positive(a: Column) -> Column:
    return F.transform(a, lambda x: (x > 0).cast("int"))


def in_bounds(point: Column, lo: Column, hi: Column) -> Column:
    """Whether every coordinate lies in its half-open range."""
    ok = F.zip_with(point, F.zip_with(lo, hi, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p, r: (p >= r["a"]) & (p < r["b"]))
    return F.forall(ok, lambda c: c)


def rescale_each(arrays: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Each array of an array to a range by itself; constant ones become their value times the lower end."""
    def one(a: Column) -> Column:
        ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
        return bind(ends, lambda e: F.transform(a, lambda x: F.when(e["hi"] > e["lo"], (x - e["lo"]) / (e["hi"] - e["lo"]) * (hi - lo) + lo).otherwise(x * lo)))

    return F.transform(arrays, one)


def rescale_to_integers(a: Column, bits: int = 16) -> Column:
    """To the whole range of unsigned integers."""
    return F.transform(rescale_each(F.array(a), 0.0, float((1 << bits) - 1))[0], lambda x: F.floor(x).cast("long"))


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Inverse of a matrix of the plan, on the driver."""
    return np.linalg.inv(np.asarray(matrix, float)).tolist()


def brats_channels(label: Column) -> Column:
    """Tumour core (1, 4), whole tumour (1, 2, 4) and enhancing tumour (4) as 0/1 channels."""
    # The classes of each channel.
    return F.array(*[F.transform(label, lambda x: x.isin(*classes).cast("int")) for classes in ((1, 4), (1, 2, 4), (4,))])  # noqa: B023


def scan_order(rows: int, cols: int, kind: str = "raster") -> list[int]:
    """Positions of a grid's cells in a scan: row by row, or turning at each end (``s_curve``)."""
    out = []
    for r in range(rows):
        line = [r * cols + c for c in range(cols)]
        out += line[::-1] if kind == "s_curve" and r % 2 else line
    return out


def reorder(a: Column, order: list[int]) -> Column:
    places = F.array(*map(F.lit, order))
    return F.transform(places, lambda i: F.element_at(a, i + 1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)
