"""Points, label positions and crop centres as array columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.functions.arrays import bind
from stratalens.functions.nd import Nd, unravel_index


def transform_points(points: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """Points (arrays of coordinates) through a homogeneous matrix."""
    n = len(matrix) - 1
    row = lambda p, i: reduce(Column.__add__, [p[j] * float(matrix[i][j]) for j in range(n)]) + float(matrix[i][n])
    return F.transform(points, lambda p: F.array(*[row(p, i) for i in range(n)]))


def indices_of(values: Column, label: object) -> Column:
    """Row-major positions of a label."""
    return F.filter(F.transform(values, lambda x, i: F.when(x == label, i)), lambda i: i.isNotNull())


def labels_present(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def center_within(center: Sequence[Column], size: Sequence[int], shape: Sequence[int]) -> list[Column]:
    """A crop's centre moved so that the crop lies inside: between half the crop's size (rounded down) and what leaves the rest."""
    out = []
    for c, k, n in zip(center, size, shape, strict=True):
        if k > n:
            raise ValueError("the crop is larger than the array")
        start, end = k // 2, int(n + 1 - k / 2)
        end += start == end
        out.append(F.least(F.greatest(c, F.lit(start)), F.lit(end - 1)).cast("int"))
    return out


def _centers(picked: Column, size: Sequence[int], shape: Sequence[int]) -> Column:
    return F.transform(picked, lambda i: F.array(*center_within(unravel_index(i, shape), size, shape)))


def _draws(n: int, one) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def crop_centers(fg: Column, bg: Column, key: Column, n: int, pos_ratio: float, size: Sequence[int], shape: Sequence[int], seed: int = 0) -> Column:
    """n crop centres, each on a foreground position with a probability, else on a background one; if one kind is missing, on the other. NULL without any."""
    ratio = F.when(F.size(fg) == 0, 0.0).when(F.size(bg) == 0, 1.0).otherwise(float(pos_ratio))

    def one(k: Column) -> Column:
        name = F.concat_ws("/", key, k)
        use = F.when(draws.unit(name, seed, "side") < ratio, fg).otherwise(bg)
        return F.element_at(use, draws.below(name, F.size(use), seed, "at") + 1)

    return F.when(F.size(fg) + F.size(bg) > 0, _centers(_draws(n, one), size, shape))


def class_crop_centers(indices: Sequence[Column], ratios: Sequence[float], key: Column, n: int, size: Sequence[int], shape: Sequence[int], seed: int = 0) -> Column:
    """n crop centres on positions of classes drawn by their ratios; classes without a position aren't drawn."""
    weight = [F.when(F.size(x) > 0, float(r)).otherwise(0.0) for x, r in zip(indices, ratios, strict=True)]
    total = reduce(Column.__add__, weight)

    def one(k: Column) -> Column:
        name = F.concat_ws("/", key, k)
        u, use, upto = draws.unit(name, seed, "class") * total, indices[-1], F.lit(0.0)
        bounds = []
        for w in weight:
            upto = upto + w
            bounds.append(upto)
        for x, b in reversed(list(zip(indices, bounds, strict=True))):
            use = F.when(u < b, x).otherwise(use)
        return F.element_at(use, draws.below(name, F.size(use), seed, "at") + 1)

    return F.when(total > 0, _centers(_draws(n, one), size, shape))


def extreme_points(mask: Nd, above: float = 0.0) -> Column:
    """For each axis the first cells, in row-major order, of the foreground at its least and at its greatest coordinate."""
    at = F.filter(F.transform(mask.data, lambda v, i: F.when(v > above, F.array(*[c.cast("int") for c in unravel_index(i, mask.shape)]))), lambda p: p.isNotNull())
    picked = []
    for k in range(len(mask.shape)):
        coordinate = F.transform(at, lambda p: p[k])  # noqa: B023
        for end in (F.array_min(coordinate), F.array_max(coordinate)):
            picked.append(F.element_at(at, F.array_position(coordinate, end).cast("int")))
    return F.when(F.size(at) > 0, F.array(*picked))


def discs(points: Column, shape: Sequence[int], radius: float) -> Column:
    """A dense 0/1 array of the cells within a radius of any point."""
    from stratalens.functions.nd import product

    def cell(i: Column) -> Column:
        at = unravel_index(i, shape)
        near = lambda p: reduce(Column.__add__, [(p[k] - c) * (p[k] - c) for k, c in enumerate(at)]) <= radius * radius
        return F.exists(points, near).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(product(shape)) - 1), cell)


def guidance_signal(points: Column, shape: Sequence[int], sigma: float) -> Column:
    """A dense array of bell curves around points, scaled to [0, 1]; zeros without points."""
    from stratalens.functions.nd import product

    def cell(i: Column) -> Column:
        at = unravel_index(i, shape)
        bell = lambda p: F.exp(-reduce(Column.__add__, [(p[k] - c) * (p[k] - c) for k, c in enumerate(at)]) / (2 * sigma * sigma))
        return F.aggregate(F.transform(points, bell), F.lit(0.0), lambda a, b: a + b)

    raw = F.transform(F.sequence(F.lit(0), F.lit(product(shape)) - 1), cell)
    ends = bind(raw, lambda r: F.struct(r.alias("r"), F.array_min(r).alias("lo"), F.array_max(r).alias("hi")))
    return bind(ends, lambda e: F.transform(e["r"], lambda x: F.when(e["hi"] > e["lo"], (x - e["lo"]) / (e["hi"] - e["lo"])).otherwise(F.lit(0.0))))
