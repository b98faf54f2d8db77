"""Functions of array columns by higher-order functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once for the row, though lambdas refer to it for every element."""
    return F.transform(F.array(value), use)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def argmax(a: Column) -> Column:
    """Position of the first greatest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    e = bind(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return bind(e, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x)))


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("int"))


def threshold(a: Column, at: float) -> Column:
    """1 from the threshold on, else 0."""
    return F.transform(a, lambda x: (x >= at).cast("int"))


def pad(a: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), a, F.array_repeat(F.lit(value), after))


def pad_to(a: Column, size: int, value: float = 0.0, symmetric: bool = True) -> Column:
    """Pad to a size, half before (rounded down) and the rest after, or all after."""
    w = F.greatest(F.lit(size) - F.size(a), F.lit(0))
    before = F.floor(w / 2).cast("int") if symmetric else F.lit(0)
    return F.concat(F.array_repeat(F.lit(value), before), a, F.array_repeat(F.lit(value), w - before))


def crop(a: Column, start: int, end: int) -> Column:
    """Elements from start to before end, clipped to the array."""
    start = max(start, 0)
    return F.slice(a, start + 1, max(end, start) - start)


def center_crop(a: Column, size: int) -> Column:
    start = F.greatest(F.floor(F.size(a) / 2).cast("int") - size // 2, F.lit(0))
    return F.slice(a, start + 1, F.lit(size))


def resize_with_pad_or_crop(a: Column, size: int, value: float = 0.0) -> Column:
    return center_crop(pad_to(a, size, value), size)


def flip(a: Column) -> Column:
    return F.reverse(a)


def roll(a: Column, by: int) -> Column:
    n = F.size(a)
    k = F.pmod(F.lit(by), n)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))


def cumsum(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: total(F.slice(a, F.lit(1), i)))


def norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda x, y: x + y * y))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def foreground(a: Column, above: float = 0.0) -> Column:
    """Positions of elements above a threshold."""
    return F.filter(F.transform(a, lambda x, i: F.when(x > above, i)), lambda i: i.isNotNull())


def foreground_box(a: Column, above: float = 0.0, margin: int = 0) -> Column:
    """struct(start, end) around the foreground, end exclusive; no foreground gives 0, 0."""
    at = foreground(a, above)
    none = F.size(at) == 0
    start = F.when(none, 0).otherwise(F.greatest(F.array_min(at) - margin, F.lit(0)))
    end = F.when(none, 0).otherwise(F.least(F.array_max(at) + 1 + margin, F.size(a)))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def as_doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))
