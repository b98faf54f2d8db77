"""Signals: windows over rows in order, and deterministic generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import draws


def frame(by: list[str], order: list[str], before: int, after: int):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)


def moving_average(df: DataFrame, value: str, by: list[str], order: list[str], half: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(frame(by, order, half, half)))


def median_smooth(df: DataFrame, value: str, by: list[str], order: list[str], half: int, name: str) -> DataFrame:
    """Median of a centred frame; an even number of values gives the mean of the two in the middle."""
    near = F.array_sort(F.collect_list(value).over(frame(by, order, half, half)))
    n = F.size("__near")
    mid = (F.element_at("__near", F.floor((n + 1) / 2).cast("int")) + F.element_at("__near", F.floor(n / 2).cast("int") + 1)) / 2
    return df.withColumn("__near", near).withColumn(name, F.when(n > 0, mid)).drop("__near")


def savitzky_golay(half: int, degree: int) -> list[float]:
    """Weights of the least-squares polynomial's middle value, from normal equations."""
    import numpy as np

    x = np.arange(-half, half + 1)
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0].tolist()


def convolve(df: DataFrame, value: str, by: list[str], order: list[str], weights: list[float], name: str, mode: str | None = "zeros") -> DataFrame:
    """Weighted sum over a centred frame, with a value for every row.

    Beyond the ends stand zeros, the end's value (``replicate``), the rows mirrored at the end row
    (``reflect``) or those of the other end (``circular``); with None the result is NULL there. Groups that are
    shorter than the frame's half have NULL where a mirrored or circular row doesn't exist.
    """
    half = len(weights) // 2
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_start, from_end = F.row_number().over(w), F.count("*").over(whole) - F.row_number().over(w) + 1
    nth = lambda frame, k: F.nth_value(value, k).over(frame)

    def beyond(k: int):
        """The value k rows off where that is outside."""
        if mode is None:
            return F.lit(None).cast("double")
        if mode == "zeros":
            return F.lit(0.0)
        place, near, far = (from_start, whole, back) if k < 0 else (from_end, back, whole)
        if mode == "replicate":
            return nth(near, 1)
        out = F.lit(None).cast("double")
        for r in range(1, abs(k) + 1):  # rows at r from the end reach abs(k) - r + 1 beyond it
            out = F.when(place == r, nth(near, abs(k) - r + 2) if mode == "reflect" else nth(far, abs(k) - r + 1)).otherwise(out)
        return out

    total = None
    for i, x in enumerate(weights):
        k = i - half
        inside = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        there = F.col(value) if not k else F.when(from_start + k < 1, beyond(k)).when(from_end - k < 1, beyond(k)).otherwise(inside)
        total = F.lit(float(x)) * there if total is None else total + F.lit(float(x)) * there
    return df.withColumn(name, total)


def erode(df: DataFrame, value: str, by: list[str], order: list[str], half: int, name: str) -> DataFrame:
    return df.withColumn(name, F.min(value).over(frame(by, order, half, half)))


def dilate(df: DataFrame, value: str, by: list[str], order: list[str], half: int, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(frame(by, order, half, half)))


def shift(df: DataFrame, value: str, by: list[str], order: list[str], by_rows: int, name: str, fill: float = 0.0) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.coalesce(F.lag(value, by_rows).over(w), F.lit(fill)))


def fill_empty(c: Column, value: float = 0.0) -> Column:
    """NaN and NULL become a value."""
    return F.when(c.isNull() | F.isnan(c), F.lit(value)).otherwise(c)


def sine(n: int, magnitude: float, frequency: float) -> list[float]:
    """magnitude x sin(frequency x t), t = 0, 1, ..."""
    return [magnitude * math.sin(frequency * t) for t in range(n)]


def square_pulse(n: int, magnitude: float, frequency: float) -> list[float]:
    return [magnitude * (1.0 if math.sin(frequency * t) >= 0 else -1.0) for t in range(n)]


def paste(array: Column, block: list[float], start: int) -> Column:
    """The array with a block written over it, cut off at the end."""
    return F.transform(array, lambda x, i: F.when((i >= start) & (i < start + len(block)), F.element_at(F.array(*map(F.lit, block)), F.least(F.greatest(i - start + 1, F.lit(1)), F.lit(len(block))))).otherwise(x))


# Signals as array columns.


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def rand_scale(a: Column, key: str, lo: float, hi: float, seed: int = 0) -> Column:
    """The signal plus itself times a drawn factor."""
    f = draws.between(key, lo, hi, seed)
    return F.transform(a, lambda x: x + x * f)


def rand_shift(a: Column, key: str, lo: float, hi: float, mode: str = "wrap", filling: float = 0.0, seed: int = 0) -> Column:
    """The signal moved by a drawn share of its length, around its ends (``wrap``) or with a filling."""
    n = F.size(a)
    by = F.rint(draws.between(key, lo, hi, seed) * n).cast("int")
    if mode == "wrap":
        return F.transform(a, lambda x, i: F.element_at(a, (F.pmod(i - by, n) + 1).cast("int")))
    return F.transform(a, lambda x, i: F.when((i - by >= 0) & (i - by < n), F.element_at(a, F.least(F.greatest(i - by + 1, F.lit(1)), n))).otherwise(F.lit(filling)))


def _segment(a: Column, key: str, lo: float, hi: float, seed: int) -> tuple[Column, Column]:
    """Start and length of a drawn segment: a drawn share of the signal at a drawn place."""
    length = F.floor(draws.between(key, lo, hi, seed, "len") * F.size(a)).cast("int")
    return draws.below(key, F.size(a) - length + 1, seed, "at"), length


def rand_drop(a: Column, key: str, lo: float, hi: float, seed: int = 0) -> Column:
    """A drawn segment of the signal becomes zero."""
    start, length = _segment(a, key, lo, hi, seed)
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + length), F.lit(0.0)).otherwise(x))


def rand_gaussian_noise(a: Column, key: str, lo: float, hi: float, seed: int = 0) -> Column:
    """Normal noise times a drawn magnitude."""
    m = draws.between(key, lo, hi, seed)
    return F.transform(a, lambda x, i: x + m * draws.normal(F.concat_ws("/", F.col(key), i), seed))


def _wave(kind: str, magnitude: Column, frequency: Column):
    sine_at = lambda i: F.sin(frequency * i)
    return (lambda i: magnitude * sine_at(i)) if kind == "sine" else (lambda i: magnitude * F.when(sine_at(i) >= 0, 1.0).otherwise(-1.0))


def rand_add(a: Column, key: str, kind: str, magnitudes: tuple[float, float], frequencies: tuple[float, float], seed: int = 0, part: tuple[float, float] | None = None) -> Column:
    """A sine or a square pulse of drawn magnitude and frequency added to the signal, or to a drawn segment of it."""
    wave = _wave(kind, draws.between(key, *magnitudes, seed, "m"), draws.between(key, *frequencies, seed, "f"))
    if part is None:
        return F.transform(a, lambda x, i: x + wave(i))
    start, length = _segment(a, key, *part, seed)
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + length), x + wave(i - start)).otherwise(x))


def envelope(a: Column) -> Column:
    """Magnitude of the analytic signal of short signals of even length: the signal and its Hilbert transform, a circular sum with cotangents."""
    n = F.size(a)

    def at(x: Column, k: Column) -> Column:
        terms = F.transform(a, lambda y, m: F.when(F.pmod(k - m, F.lit(2)) == 1, y * 2 / n / F.tan(math.pi * (k - m) / n)).otherwise(0.0))
        h = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
        return F.sqrt(x * x + h * h)

    return F.transform(a, at)


def notch(frequency: float, quality: float, sampling: float) -> tuple[list[float], list[float]]:
    """(b, a) of the second-order notch filter at a frequency: zeros on the unit circle, poles as far inside as the quality says."""
    w = 2 * math.pi * frequency / sampling
    gain = 1 / (1 + math.tan(w / quality / 2))
    return [gain, -2 * gain * math.cos(w), gain], [1.0, -2 * gain * math.cos(w), 2 * gain - 1]


def recursive_filter(a: Column, b: list[float], c: list[float]) -> Column:
    """Second-order recursive filter along the signal, from rest; the state runs through an aggregate."""
    zero = F.lit(0.0)
    start = F.struct(F.array().cast("array<double>").alias("y"), zero.alias("x1"), zero.alias("x2"), zero.alias("y1"), zero.alias("y2"))

    def step(s: Column, x: Column) -> Column:
        y = x * b[0] + s["x1"] * b[1] + s["x2"] * b[2] - s["y1"] * c[1] - s["y2"] * c[2]
        return F.struct(F.concat(s["y"], F.array(y)).alias("y"), x.alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"))

    return F.aggregate(a, start, step, lambda s: s["y"])


def remove_frequency(a: Column, frequency: float, quality: float, sampling: float) -> Column:
    """The notch filter forth and back, so that nothing is delayed."""
    b, c = notch(frequency, quality, sampling)
    return F.reverse(recursive_filter(F.reverse(recursive_filter(a, b, c)), b, c))
