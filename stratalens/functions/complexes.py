"""Complex arrays (array columns of struct<re, im>), coil combination and k-space masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions import draws


def of_pairs(re: Column, im: Column) -> Column:
    """Complex numbers from arrays of real and imaginary parts."""
    return F.zip_with(re, im, lambda a, b: F.struct(a.cast("double").alias("re"), b.cast("double").alias("im")))


def interleaved(a: Column) -> Column:
    """Complex numbers from an array in which each real part stands before its imaginary part."""
    at = lambda k: F.filter(F.transform(a, lambda x, i: F.when(i % 2 == k, x)), lambda x: x.isNotNull())
    return of_pairs(at(0), at(1))


def absolute(a: Column) -> Column:
    return F.transform(a, lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))


def conjugate(a: Column) -> Column:
    return F.transform(a, lambda z: F.struct(z["re"].alias("re"), (-z["im"]).alias("im")))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["re"] * y["re"] - x["im"] * y["im"]).alias("re"), (x["re"] * y["im"] + x["im"] * y["re"]).alias("im")))


def root_sum_of_squares(coils: Column) -> Column:
    """Of an array of coils (arrays of complex numbers of one length) the root of the summed squares at each place."""
    squares = F.transform(coils, lambda c: F.transform(c, lambda z: z["re"] * z["re"] + z["im"] * z["im"]))
    total = F.aggregate(F.slice(squares, F.lit(2), F.greatest(F.size(squares) - 1, F.lit(0))), squares[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(total, F.sqrt)


def _low(n: int, center: float) -> tuple[int, int]:
    """First and exclusive last of the low frequencies in the middle: round(n x center) of them."""
    low = round(n * center)
    start = (n - low + 1) // 2
    return start, start + low


def random_mask(key: Column | str, n: int, center: float, acceleration: float, seed: int = 0) -> Column:
    """Which of n columns of k-space are kept: the low ones, and each other one with the probability that leaves n / acceleration of them in all."""
    lo, hi = _low(n, center)
    p = (n / acceleration - (hi - lo)) / (n - (hi - lo))
    c = F.col(key) if isinstance(key, str) else key
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (draws.unit(F.concat_ws("/", c, i), seed) < p) | ((i >= lo) & (i < hi)))


def equispaced_mask(key: Column | str, n: int, center: float, acceleration: float, seed: int = 0) -> Column:
    """The low columns, and columns at even distances from a drawn offset; the distance is widened for what the low ones add."""
    lo, hi = _low(n, center)
    step = acceleration * ((hi - lo) - n) / ((hi - lo) * acceleration - n)
    offset = draws.below(key, max(1, round(step)), seed)
    picked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(n / step))), lambda k: k * step + offset), lambda x: x < n - 1)
    picked = F.transform(picked, lambda x: F.rint(x).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(picked, i) | ((i >= lo) & (i < hi)))


def masked(kspace: Column, mask: Column) -> Column:
    """Complex numbers, zero where the mask drops them."""
    return F.zip_with(kspace, mask, lambda z, m: F.when(m, z).otherwise(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))


def dft(a: Column, inverse: bool = False, centered: bool = False) -> Column:
    """Orthonormal discrete Fourier transform of short complex arrays, straight from its definition (n^2 steps); with ``centered`` the origin is in the middle."""
    n = F.size(a)
    sign = 1.0 if inverse else -1.0
    mid = F.floor(n / 2) if centered else F.lit(0)

    def out(_, k: Column) -> Column:
        angle = lambda m: sign * 2 * math.pi * F.pmod((k - mid) * (m - mid), n) / n
        part = lambda f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda x, y: x + y) / F.sqrt(n)
        re = part(lambda z, m: z["re"] * F.cos(angle(m)) - z["im"] * F.sin(angle(m)))
        im = part(lambda z, m: z["re"] * F.sin(angle(m)) + z["im"] * F.cos(angle(m)))
        return F.struct(re.alias("re"), im.alias("im"))

    return F.transform(a, out)
