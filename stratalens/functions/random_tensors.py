"""Randomised array transforms: each row's draws depend on the seed and the row's key alone.

So results repeat whatever the partitions, the order or lost executors. A kernel takes an array and a
numpy Generator; ``apply_random`` runs a chain in one pass. ``sometimes`` gives a kernel a probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import tensors as X

RandomKernel = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def apply_random(df: DataFrame, kernels: Sequence[RandomKernel], key: str, seed: int = 0, shape: str = "shape", data: str = "data") -> DataFrame:
    """(key, shape, data) after a chain of randomised kernels; null arrays stay null."""

    def run(it):
        for batch in it:
            shapes, flat = [], []
            for h, s, v in zip(batch.column("h").to_pylist(), batch.column("s").to_pylist(), batch.column("d"), strict=True):
                if not v.is_valid or s is None:
                    shapes.append(None)
                    flat.append(None)
                    continue
                a, rng = np.asarray(v.values, float).reshape(s), np.random.Generator(np.random.Philox(h & (1 << 64) - 1))
                for k in kernels:
                    a = np.asarray(k(a, rng), float)
                shapes.append(list(a.shape))
                flat.append(a.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(shapes, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.float64()))], [key, shape, data])

    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(shape).cast("array<int>").alias("s"), F.col(data).cast("array<double>").alias("d"))
    return rows.mapInArrow(run, f"{key} {kind}, {shape} array<int>, {data} array<double>")


def sometimes(kernel: RandomKernel, probability: float) -> RandomKernel:
    return lambda a, rng: kernel(a, rng) if rng.random() < probability else a


def always(kernel: X.Kernel) -> RandomKernel:
    return lambda a, rng: kernel(a)


def one_of(kernels: Sequence[RandomKernel], weights: Sequence[float] | None = None) -> RandomKernel:
    p = np.ones(len(kernels)) if weights is None else np.asarray(weights, float)
    return lambda a, rng: kernels[rng.choice(len(kernels), p=p / p.sum())](a, rng)


def in_random_order(kernels: Sequence[RandomKernel]) -> RandomKernel:
    def f(a, rng):
        for k in rng.permutation(len(kernels)):
            a = kernels[k](a, rng)
        return a

    return f


# Intensity.


def gaussian_noise(mean: float = 0.0, std: float = 0.1) -> RandomKernel:
    return lambda a, rng: a + rng.normal(mean, rng.uniform(0, std), a.shape)


def rician_noise(std: float = 0.1) -> RandomKernel:
    return lambda a, rng: np.hypot(a + rng.normal(0, std, a.shape), rng.normal(0, std, a.shape))


def scale_intensity(low: float, high: float) -> RandomKernel:
    return lambda a, rng: a * (1 + rng.uniform(low, high))


def shift_intensity(low: float, high: float) -> RandomKernel:
    return lambda a, rng: a + rng.uniform(low, high)


def adjust_contrast(low: float = 0.5, high: float = 4.5) -> RandomKernel:
    return lambda a, rng: X.gamma(rng.uniform(low, high))(a)


def smooth(low: float = 0.25, high: float = 1.5) -> RandomKernel:
    return lambda a, rng: X.gaussian_smooth(rng.uniform(low, high))(a)


def histogram_shift(points: int = 10) -> RandomKernel:
    """A piecewise linear map of the value range whose inner control points lie anywhere between the point before and the next grid place."""

    def f(a, rng):
        grid = np.linspace(0, 1, points)
        draws = rng.random(points)
        level = accumulate(zip(grid[2:], draws[1:-1], strict=True), lambda low, up: low + (up[0] - low) * up[1], initial=0.0)
        return X.histogram_shift(list(zip(grid, [*level, 1.0], strict=True)))(a)

    return f


def bias_field(degree: int = 3, low: float = 0.0, high: float = 0.1) -> RandomKernel:
    def f(a, rng):
        n = math.comb(degree + a.ndim, a.ndim)
        return X.bias_field(rng.uniform(low, high, n).tolist(), degree)(a)

    return f


def spike(low: float, high: float) -> RandomKernel:
    """One frequency of the logarithmic spectrum set to a drawn intensity."""

    def f(a, rng):
        k = X.fft_centered(a)
        at = tuple(int(rng.integers(n)) for n in a.shape)
        k[at] = np.exp(rng.uniform(low, high)) * np.exp(1j * np.angle(k[at]))
        return X.fft_centered(k, True).real

    return f


def coarse_dropout(holes: int, size: Sequence[int], fill: float = 0.0) -> RandomKernel:
    def f(a, rng):
        a = a.copy()
        for _ in range(holes):
            a[_box(a.shape, size, rng)] = fill
        return a

    return f


def coarse_shuffle(holes: int, size: Sequence[int]) -> RandomKernel:
    def f(a, rng):
        a = a.copy()
        for _ in range(holes):
            b = _box(a.shape, size, rng)
            a[b] = rng.permutation(a[b].ravel()).reshape(a[b].shape)
        return a

    return f


def std_shift(low: float, high: float) -> RandomKernel:
    """A drawn factor times the deviation is added."""
    return lambda a, rng: a + rng.uniform(low, high) * a.std()


def fixed_mean_scale(low: float, high: float, fixed_mean: bool = True, preserve_range: bool = False) -> RandomKernel:
    """Scaled by 1 plus a drawn factor about the mean, optionally held in the old range."""

    def f(a, rng):
        mid = a.mean() if fixed_mean else 0.0
        out = (a - mid) * (1 + rng.uniform(low, high)) + mid
        return np.clip(out, a.min(), a.max()) if preserve_range else out

    return f


def gaussian_sharpen(blur: tuple[float, float] = (0.5, 1.0), finer: tuple[float, float] = (0.5, 0.5), alpha: tuple[float, float] = (10.0, 30.0)) -> RandomKernel:
    return lambda a, rng: X.gaussian_sharpen(rng.uniform(*blur), rng.uniform(*finer), rng.uniform(*alpha))(a)


def gibbs(low: float = 0.0, high: float = 1.0) -> RandomKernel:
    return lambda a, rng: X.gibbs(rng.uniform(low, high))(a)


def filtered(kernel: X.Kernel) -> RandomKernel:
    """A filter; give it a probability with ``sometimes``."""
    return always(kernel)


def intensity_remap(points: int = 5, slope: float = 0.7) -> RandomKernel:
    """Grey levels through a drawn curve: so many levels of the range in a drawn order, blended with the identity by a slope."""

    def f(a, rng):
        lo, hi = a.min(), a.max()
        if lo == hi:
            return a
        levels = np.linspace(lo, hi, points)
        return slope * a + (1 - slope) * np.interp(a, levels, rng.permutation(levels))

    return f


def smooth_field(cells: Sequence[int], low: float, high: float, shape: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """Drawn values on a coarse grid, one beyond each side, interpolated to a shape."""
    return X.resize(shape)(rng.uniform(low, high, cells))


def smooth_field_contrast(cells: Sequence[int], low: float = 0.5, high: float = 4.5) -> RandomKernel:
    """A gamma that changes smoothly over the array."""

    def f(a, rng):
        lo, span = a.min(), a.max() - a.min()
        gamma = smooth_field(cells, low, high, a.shape, rng)
        return a if span == 0 else ((a - lo) / span) ** gamma * span + lo

    return f


def smooth_field_intensity(cells: Sequence[int], low: float = 0.1, high: float = 1.0) -> RandomKernel:
    """A factor that changes smoothly over the array."""
    return lambda a, rng: a * smooth_field(cells, low, high, a.shape, rng)


def smooth_deform(cells: Sequence[int], extent: float = 1.0) -> RandomKernel:
    """A displacement that changes smoothly over the array, at most so many cells."""
    return lambda a, rng: X.warp(np.stack([smooth_field(cells, -extent, extent, a.shape, rng) for _ in range(a.ndim)]))(a)


def low_resolution(low: float = 0.5, high: float = 1.0) -> RandomKernel:
    """Sampled down by a drawn zoom to the nearest cells, and back to the old size by interpolation."""

    def f(a, rng):
        z = rng.uniform(low, high)
        small = X.resize([max(1, round(n * z)) for n in a.shape], "nearest")(a)
        return X.resize(a.shape)(small)

    return f


# Space.


def _box(shape: Sequence[int], size: Sequence[int], rng: np.random.Generator) -> tuple[slice, ...]:
    start = [int(rng.integers(0, max(n - min(k, n), 0) + 1)) for n, k in zip(shape, size, strict=True)]
    return tuple(slice(s, s + min(k, n)) for s, k, n in zip(start, size, shape, strict=True))


def crop(size: Sequence[int], largest: Sequence[int] | None = None) -> RandomKernel:
    """A box of a size, or of one drawn up to a largest, at a drawn place."""

    def f(a, rng):
        roi = size if largest is None else [int(rng.integers(lo, hi + 1)) for lo, hi in zip(size, largest, strict=True)]
        return a[_box(a.shape, roi, rng)]

    return f


def crop_by_label(size: Sequence[int], label: Callable[[np.ndarray], np.ndarray], positive: float = 0.5) -> RandomKernel:
    """A box centred on a foreground or background cell; if one kind is missing the other is taken."""

    def f(a, rng):
        mask = label(a)
        fg, bg = np.flatnonzero(mask), np.flatnonzero(~mask)
        pool = fg if len(fg) and (not len(bg) or rng.random() < positive) else bg
        at = np.unravel_index(int(rng.choice(pool)), a.shape)
        start = [min(max(c - k // 2, 0), max(n - k, 0)) for c, k, n in zip(at, size, a.shape, strict=True)]
        return a[tuple(slice(s, s + k) for s, k in zip(start, size, strict=True))]

    return f


def scale_crop(low: Sequence[float], high: Sequence[float] | None = None) -> RandomKernel:
    """A box of a share of each axis, or of one drawn up to a larger share."""

    def f(a, rng):
        share = low if high is None else [rng.uniform(x, y) for x, y in zip(low, high, strict=True)]
        return a[_box(a.shape, [math.ceil(n * x) for n, x in zip(a.shape, share, strict=True)], rng)]

    return f


def weighted_crop(size: Sequence[int], weight: Callable[[np.ndarray], np.ndarray]) -> RandomKernel:
    """A box centred on a cell drawn in proportion to its weight; negative weights are shifted by the least, and equal ones draw evenly."""

    def f(a, rng):
        w = np.asarray(weight(a), float).ravel()
        w = w - min(0.0, w.min())
        up = np.cumsum(w)
        at = int(np.searchsorted(up, rng.random() * up[-1], "right")) if up[-1] > 0 else int(rng.integers(len(w)))
        at = np.unravel_index(min(at, len(w) - 1), a.shape)
        start = [min(max(c - k // 2, 0), max(n - k, 0)) for c, k, n in zip(at, size, a.shape, strict=True)]
        return a[tuple(slice(s, s + k) for s, k in zip(start, size, strict=True))]

    return f


def flip(axes: Sequence[int]) -> RandomKernel:
    return lambda a, rng: np.flip(a, tuple(axes))


def axis_flip() -> RandomKernel:
    return lambda a, rng: np.flip(a, int(rng.integers(a.ndim)))


def rotate90(most: int = 3, axes: tuple[int, int] = (0, 1)) -> RandomKernel:
    return lambda a, rng: np.rot90(a, int(rng.integers(1, most + 1)), axes)


def rotate(angle: float) -> RandomKernel:
    return lambda a, rng: X.rotate(rng.uniform(-angle, angle))(a)


def zoom(low: float, high: float) -> RandomKernel:
    """Zoomed about the centre; the shape stays."""

    def f(a, rng):
        return X.pad_to(a.shape)(X.center_crop(a.shape)(X.zoom(rng.uniform(low, high))(a)))

    return f


def affine(rotate: float = 0.0, scale: float = 0.0, shear: float = 0.0, translate: float = 0.0) -> RandomKernel:
    """Two axes: rotation, scale, shear and translation about the centre."""

    def f(a, rng):
        t = rng.uniform(-rotate, rotate)
        m = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) @ np.array([[1, rng.uniform(-shear, shear)], [rng.uniform(-shear, shear), 1]]) @ np.diag(1 + rng.uniform(-scale, scale, 2))
        mid = (np.array(a.shape) - 1) / 2
        full = np.eye(3)
        full[:2, :2], full[:2, 2] = m, mid - m @ mid + rng.uniform(-translate, translate, 2)
        return X.affine(full)(a)

    return f


def elastic(sigma: float, magnitude: float) -> RandomKernel:
    """A smoothed random displacement."""

    def f(a, rng):
        field = np.stack([X.gaussian_smooth(sigma)(rng.uniform(-1, 1, a.shape)) for _ in range(a.ndim)])
        return X.warp(field * magnitude)(a)

    return f


def grid_distortion(cells: int = 5, limit: float = 0.3) -> RandomKernel:
    """Cell borders of a grid move along each axis; what lies between is stretched."""

    def f(a, rng):
        axes = []
        for n in a.shape:
            steps = 1 + rng.uniform(-limit, limit, cells)
            at = np.concatenate([[0], np.cumsum(steps)]) / steps.sum() * (n - 1)
            axes.append(np.interp(np.arange(n), np.linspace(0, n - 1, cells + 1), at))
        grid = np.stack(np.meshgrid(*axes, indexing="ij"))
        return X.sample(a, grid.reshape(a.ndim, -1)).reshape(a.shape)

    return f


# Mixing of two arrays of one shape.


def mixup(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, alpha: float = 1.0) -> np.ndarray:
    w = rng.beta(alpha, alpha)
    return w * a + (1 - w) * b


def cutmix(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, alpha: float = 1.0) -> np.ndarray:
    share = (1 - rng.beta(alpha, alpha)) ** (1 / a.ndim)
    box = _box(a.shape, [max(1, int(n * share)) for n in a.shape], rng)
    out = a.copy()
    out[box] = b[box]
    return out


def cutout(a: np.ndarray, rng: np.random.Generator, alpha: float = 1.0) -> np.ndarray:
    return cutmix(a, np.zeros_like(a), rng, alpha)
