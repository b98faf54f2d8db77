"""Dense arrays in the JVM: values of an array column (row-major) with a shape, moved by index arithmetic.

``Nd`` holds a data column and the sizes of its axes, each a number or a column. Every operation gives
another one; nothing leaves Catalyst. Axes may be negative.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import draws

Size = int | Column


def _col(n: Size) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def product(sizes: Sequence[Size]) -> Size:
    return reduce(lambda a, b: a * b, sizes, 1)


def ravel_index(at: Sequence[Size], shape: Sequence[Size]) -> Size:
    """Row-major position of coordinates."""
    return reduce(lambda acc, x: acc * x[1] + x[0], zip(at, shape, strict=True), 0)


def unravel_index(i: Column, shape: Sequence[Size]) -> list[Column]:
    """Coordinates of a row-major position."""
    out: list[Column] = []
    for n in reversed(shape):
        out.append(F.pmod(i, _col(n)))
        i = F.floor(i / _col(n))
    return out[::-1]


def unravel_indices(positions: Column, shape: Sequence[Size]) -> Column:
    """Coordinates of every position of an array column."""
    return F.transform(positions, lambda i: F.array(*[c.cast("int") for c in unravel_index(i, shape)]))


@dataclass(frozen=True)
class Nd:
    data: Column
    shape: tuple[Size, ...]

    def _axis(self, a: int) -> int:
        return a % len(self.shape)

    def gather(self, shape: Sequence[Size], source: Callable[[list[Column]], tuple[list[Column], Column | None]], fill: float = 0.0) -> Nd:
        """An array of a shape whose cell at some coordinates is this one's at the coordinates that ``source`` gives, or ``fill`` where its condition fails."""
        total = product(shape)

        def cell(i: Column) -> Column:
            at, inside = source(unravel_index(i, shape))
            value = F.element_at(self.data, (ravel_index(at, self.shape) + 1).cast("int"))
            return value if inside is None else F.when(inside, value).otherwise(F.lit(fill))

        cells = F.transform(F.sequence(F.lit(0), _col(total) - 1), cell)
        return Nd(F.when(_col(total) > 0, cells).otherwise(F.slice(self.data, 1, 0)), tuple(shape))

    def transpose(self, order: Sequence[int]) -> Nd:
        return self.gather([self.shape[k] for k in order], lambda at: ([at[list(order).index(k)] for k in range(len(order))], None))

    def moveaxis(self, source: int, target: int) -> Nd:
        order = [k for k in range(len(self.shape)) if k != self._axis(source)]
        order.insert(self._axis(target), self._axis(source))
        return self.transpose(order)

    def channel_last(self) -> Nd:
        return self.moveaxis(0, -1)

    def channel_first(self, channel: int | None = -1) -> Nd:
        """The channel axis in front; without one (None) an axis of size 1."""
        return Nd(self.data, (1, *self.shape)) if channel is None else self.moveaxis(channel, 0)

    def squeeze(self, axis: int | None = 0) -> Nd:
        """Without an axis of size 1, or (None) without all of them."""
        gone = [k for k, n in enumerate(self.shape) if (k == self._axis(axis) if axis is not None else n == 1)]
        if any(isinstance(self.shape[k], int) and self.shape[k] != 1 for k in gone):
            raise ValueError("the axis is larger than 1")
        return Nd(self.data, tuple(n for k, n in enumerate(self.shape) if k not in gone))

    def flip(self, axes: Sequence[int]) -> Nd:
        hit = {self._axis(a) for a in axes}
        return self.gather(self.shape, lambda at: ([_col(n) - 1 - c if k in hit else c for k, (c, n) in enumerate(zip(at, self.shape, strict=True))], None))

    def rotate90(self, k: int = 1, axes: tuple[int, int] = (0, 1)) -> Nd:
        """Turned k times by 90 degrees from the first towards the second axis."""
        a, b = map(self._axis, axes)
        if k % 4 == 0:
            return self
        if k % 4 == 2:
            return self.flip([a, b])
        order = list(range(len(self.shape)))
        order[a], order[b] = b, a
        return self.flip([b]).transpose(order) if k % 4 == 1 else self.transpose(order).flip([b])

    def pad(self, width: Sequence[tuple[int, int]], mode: str = "constant", value: float = 0.0) -> Nd:
        """Wider by so many cells on each side of each axis: a value, the edge's, mirrored at the edge (``reflect``), mirrored with it (``symmetric``), or from the other side (``wrap``)."""
        shape = [n + lo + hi for n, (lo, hi) in zip(self.shape, width, strict=True)]

        def source(at):
            own = [c - lo for c, (lo, _) in zip(at, width, strict=True)]
            if mode == "constant":
                return own, reduce(Column.__and__, [(c >= 0) & (c < _col(n)) for c, n in zip(own, self.shape, strict=True)])
            put = {
                "edge": lambda c, n: F.least(F.greatest(c, F.lit(0)), n - 1),
                "wrap": lambda c, n: F.pmod(c, n),
                "symmetric": lambda c, n: F.least(F.pmod(c, 2 * n), 2 * n - 1 - F.pmod(c, 2 * n)),
                "reflect": lambda c, n: F.least(F.pmod(c, F.greatest(2 * n - 2, F.lit(1))), F.greatest(2 * n - 2, F.lit(0)) - F.pmod(c, F.greatest(2 * n - 2, F.lit(1)))),
            }[mode]
            return [put(c, _col(n)) for c, n in zip(own, self.shape, strict=True)], None

        return self.gather(shape, source, value)

    def crop(self, start: Sequence[Size], size: Sequence[Size]) -> Nd:
        """Cells from start on, so many on each axis; the caller keeps them inside."""
        return self.gather(size, lambda at: ([c + _col(s) for c, s in zip(at, start, strict=True)], None))

    def center_crop(self, size: Sequence[int]) -> Nd:
        size = [min(n, k) if isinstance(n, int) else k for n, k in zip(self.shape, size, strict=True)]
        return self.crop([n // 2 - k // 2 if isinstance(n, int) else F.floor(n / 2) - k // 2 for n, k in zip(self.shape, size, strict=True)], size)

    def scale_crop(self, scale: Sequence[float]) -> Nd:
        """The middle part of each axis, ceil(scale x size) cells of it."""
        import math

        return self.center_crop([math.ceil(n * s) for n, s in zip(self.shape, scale, strict=True)])

    def repeat_channel(self, times: int) -> Nd:
        """Each channel (first axis) so many times one after the other."""
        return self.gather((self.shape[0] * times, *self.shape[1:]), lambda at: ([F.floor(at[0] / times), *at[1:]], None))

    def remove_repeated_channel(self, times: int) -> Nd:
        """Every so many-th channel."""
        n = self.shape[0]
        return self.gather((-(-n // times) if isinstance(n, int) else F.ceil(n / times).cast("int"), *self.shape[1:]), lambda at: ([at[0] * times, *at[1:]], None))

    def resize_nearest(self, size: Sequence[int]) -> Nd:
        """Another size; each cell takes the one whose place holds its middle."""
        return self.gather(size, lambda at: ([F.floor((c + 0.5) * _col(n) / k).cast("int") for c, n, k in zip(at, self.shape, size, strict=True)], None))

    def paste(self, shape: Sequence[int], start: Sequence[Size], fill: float = 0.0) -> Nd:
        """This array at a place in a larger one; what reaches beyond that is cut off."""

        def source(at: list[Column]):
            own = [c - _col(s) for c, s in zip(at, start, strict=True)]
            return own, reduce(Column.__and__, [(c >= 0) & (c < _col(n)) for c, n in zip(own, self.shape, strict=True)])

        return self.gather(shape, source, fill)

    def around(self, center: Sequence[Size], size: Sequence[int], fill: float = 0.0) -> Nd:
        """A box of a size about a cell, its middle (rounded down) on it; cells outside are ``fill``."""

        def source(at: list[Column]):
            own = [c + _col(m) - k // 2 for c, m, k in zip(at, center, size, strict=True)]
            return own, reduce(Column.__and__, [(c >= 0) & (c < _col(n)) for c, n in zip(own, self.shape, strict=True)])

        return self.gather(size, source, fill)

    def shift_frequencies(self, axes: Sequence[int] | None = None, back: bool = False) -> Nd:
        """The first cell of each axis moved to its middle, or back."""
        hit = {self._axis(a) for a in axes} if axes is not None else set(range(len(self.shape)))

        def source(at: list[Column]):
            by = [F.floor(_col(n) / 2) if not back else -F.floor(_col(n) / 2) for n in self.shape]
            return [F.pmod(c - b, _col(n)).cast("int") if k in hit else c for k, (c, b, n) in enumerate(zip(at, by, self.shape, strict=True))], None

        return self.gather(self.shape, source)

    def margins_are_zero(self, margin: int) -> Column:
        """Whether all cells less than a margin away from an end of any axis are zero."""

        def inner(x: Column, i: Column) -> Column:
            at = unravel_index(i, self.shape)
            return (x == 0) | reduce(Column.__and__, [(c >= margin) & (c < _col(n) - margin) for c, n in zip(at, self.shape, strict=True)])

        return F.forall(F.transform(self.data, inner), lambda ok: ok)

    def peaks(self, box: Sequence[int], threshold: float, most: int) -> Column:
        """Greedy suppression of a dense map of probabilities: the greatest cell above a threshold is taken (the first of equal ones), the box about it becomes zero, and so on; array of (value, place)."""
        start = F.struct(self.data.alias("m"), F.array().cast("array<struct<value:double,place:int>>").alias("out"))

        def step(s: Column, _: Column) -> Column:
            top = F.array_max(s["m"])
            place = (F.array_position(s["m"], top) - 1).cast("int")
            mid = unravel_index(place, self.shape)

            def clear(x: Column, i: Column) -> Column:
                at = unravel_index(i, self.shape)
                inside = reduce(Column.__and__, [(c >= m - b // 2) & (c < m + b - b // 2) for c, m, b in zip(at, mid, box, strict=True)])
                return F.when(inside, F.lit(0.0)).otherwise(x)

            found = F.struct(F.transform(s["m"], clear).alias("m"), F.concat(s["out"], F.array(F.struct(top.alias("value"), place.alias("place")))).alias("out"))
            return F.when(top > threshold, found).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["out"])

    def neighbours(self, radius: int = 1, fill: float | None = None) -> Column:
        """For each cell the array of the values around it; those outside are left out, or ``fill``."""
        from itertools import product as offsets

        total = product(self.shape)

        def around(i: Column) -> Column:
            at, values = unravel_index(i, self.shape), []
            for off in offsets(range(-radius, radius + 1), repeat=len(self.shape)):
                there = [c + o for c, o in zip(at, off, strict=True)]
                inside = reduce(Column.__and__, [(c >= 0) & (c < _col(n)) for c, n in zip(there, self.shape, strict=True)])
                values.append(F.when(inside, F.element_at(self.data, (ravel_index(there, self.shape) + 1).cast("int"))).otherwise(F.lit(fill).cast("double")))
            return F.filter(F.array(*values), lambda v: v.isNotNull())

        return F.transform(F.sequence(F.lit(0), _col(total) - 1), around)

    def erode(self, radius: int = 1) -> Nd:
        return Nd(F.transform(self.neighbours(radius), F.array_min), self.shape)

    def dilate(self, radius: int = 1) -> Nd:
        return Nd(F.transform(self.neighbours(radius), F.array_max), self.shape)

    def mean_filter(self, radius: int = 1) -> Nd:
        """Mean of the cells around, zeros outside."""
        n = (2 * radius + 1) ** len(self.shape)
        return Nd(F.transform(self.neighbours(radius), lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n), self.shape)

    # Draws: a function of the row's key and a seed alone.

    def rand_noise(self, key: Column, mean: float, std: float, probability: float, seed: int = 0) -> Nd:
        """Normal noise of a drawn deviation up to ``std``, with the given probability."""
        noisy = F.transform(self.data, lambda x, i: x + mean + draws.normal(F.concat_ws("/", key, i), seed) * draws.between(key, 0, std, seed, "s"))
        return Nd(F.when(draws.happens(key, probability, seed), noisy).otherwise(self.data), self.shape)

    def _chosen(self, k: Column, options: dict[int, Nd]) -> Nd:
        out = self.data
        for i, x in options.items():
            out = F.when(k == i, x.data).otherwise(out)
        return Nd(out, self.shape)

    def rand_rotate90(self, key: Column, probability: float = 1.0, most: int = 3, seed: int = 0, axes: tuple[int, int] = (0, 1)) -> Nd:
        """One to ``most`` turns of a plane whose two axes are of one size."""
        k = F.when(draws.happens(key, probability, seed), draws.below(key, most, seed) + 1).otherwise(0)
        return self._chosen(k, {i: self.rotate90(i, axes) for i in range(1, most + 1)})

    def rand_axis_flip(self, key: Column, probability: float = 1.0, seed: int = 0) -> Nd:
        a = F.when(draws.happens(key, probability, seed), draws.below(key, len(self.shape), seed)).otherwise(-1)
        return self._chosen(a, {i: self.flip([i]) for i in range(len(self.shape))})

    def rand_crop(self, key: Column, size: Sequence[int], seed: int = 0) -> Nd:
        """A crop of a size at a drawn place."""
        start = [draws.below(key, _col(n) - k + 1, seed, f"c{a}") for a, (n, k) in enumerate(zip(self.shape, size, strict=True))]
        return self.crop(start, size)


def split_dim(df: DataFrame, data: str, shape: Sequence[int], axis: int = 0, name: str = "part") -> DataFrame:
    """One row for each slice along an axis: its number in ``name``, its values in ``data``."""
    x = Nd(F.col(data), tuple(shape))
    others = [k for k in range(len(shape)) if k != axis]
    parts = F.array(*[F.struct(F.lit(i).alias("i"), x.gather([shape[k] for k in others], lambda at, i=i: ([*at[:axis], F.lit(i), *at[axis:]], None)).data.alias("v")) for i in range(shape[axis])])
    return df.withColumn("__p", F.explode(parts)).withColumn(name, F.col("__p.i")).withColumn(data, F.col("__p.v")).drop("__p")
