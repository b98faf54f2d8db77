"""Transforms of dense arrays (columns shape and data, row-major) by numpy kernels on Arrow batches.

For operations that need an array's neighbourhood structure. A kernel takes and gives an ndarray;
``apply`` runs a chain of them in one pass over a column, so arrays cross to Python once for a chain.
Kernels work on spatial arrays without a channel axis; ``per_channel`` maps one over a leading axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]


def apply(df: DataFrame, kernels: Sequence[Kernel], key: str, shape: str = "shape", data: str = "data") -> DataFrame:
    """(key, shape, data) after a chain of kernels; null arrays stay null."""

    def run(it):
        for batch in it:
            shapes, flat = [], []
            for s, v in zip(batch.column("s").to_pylist(), batch.column("d"), strict=True):
                if not v.is_valid or s is None:
                    shapes.append(None)
                    flat.append(None)
                    continue
                a = np.asarray(v.values, float).reshape(s)
                for k in kernels:
                    a = np.asarray(k(a), float)
                shapes.append(list(a.shape))
                flat.append(a.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(shapes, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.float64()))], [key, shape, data])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(shape).cast("array<int>").alias("s"), F.col(data).cast("array<double>").alias("d")).mapInArrow(run, f"{key} {kind}, {shape} array<int>, {data} array<double>")


def per_channel(kernel: Kernel) -> Kernel:
    return lambda a: np.stack([kernel(c) for c in a])


# Shape and orientation.


def pad_spatial(width: Sequence[tuple[int, int]], mode: str = "constant", value: float = 0.0) -> Kernel:
    return lambda a: np.pad(a, width, mode, constant_values=value) if mode == "constant" else np.pad(a, width, mode)


def pad_to(size: Sequence[int], symmetric: bool = True, value: float = 0.0) -> Kernel:
    def f(a):
        w = [max(t - n, 0) for t, n in zip(size, a.shape, strict=True)]
        return np.pad(a, [(x // 2, x - x // 2) if symmetric else (0, x) for x in w], constant_values=value)

    return f


def divisible_pad(k: int, value: float = 0.0) -> Kernel:
    return lambda a: pad_to([math.ceil(n / k) * k if k > 0 else n for n in a.shape], True, value)(a)


def crop(start: Sequence[int], end: Sequence[int]) -> Kernel:
    return lambda a: a[tuple(slice(max(s, 0), max(e, max(s, 0))) for s, e in zip(start, end, strict=True))]


def center_crop(size: Sequence[int]) -> Kernel:
    def f(a):
        start = [max(n // 2 - k // 2, 0) for n, k in zip(a.shape, size, strict=True)]
        return a[tuple(slice(s, s + k) for s, k in zip(start, size, strict=True))]

    return f


def foreground_box(a: np.ndarray, above: float = 0.0, margin: int = 0) -> list[tuple[int, int]]:
    """Start and exclusive end of the foreground on each axis; 0, 0 without one."""
    hit = a > above
    out = []
    for axis in range(a.ndim):
        at = np.flatnonzero(hit.any(axis=tuple(k for k in range(a.ndim) if k != axis)))
        out.append((max(int(at[0]) - margin, 0), min(int(at[-1]) + 1 + margin, a.shape[axis])) if len(at) else (0, 0))
    return out


def crop_foreground(above: float = 0.0, margin: int = 0) -> Kernel:
    return lambda a: a[tuple(slice(s, e) for s, e in foreground_box(a, above, margin))]


def flip(axes: Sequence[int]) -> Kernel:
    return lambda a: np.flip(a, tuple(axes))


def rotate90(k: int = 1, axes: tuple[int, int] = (0, 1)) -> Kernel:
    return lambda a: np.rot90(a, k, axes)


def transpose(order: Sequence[int]) -> Kernel:
    return lambda a: np.transpose(a, order)


def add_coordinates() -> Kernel:
    """Coordinate channels from -0.5 to 0.5 behind a channel-first array."""

    def f(a):
        axes = [np.linspace(-0.5, 0.5, n) for n in a.shape[1:]]
        return np.concatenate([a, np.stack(np.meshgrid(*axes, indexing="ij"))])

    return f


# Resampling.


def sample(a: np.ndarray, at: np.ndarray, mode: str = "linear", outside: str = "border") -> np.ndarray:
    """Values at fractional positions (axes x points); outside the array the border's or zero."""
    shape = np.array(a.shape)[:, None]
    if mode == "nearest":
        k = np.floor(at + 0.5).astype(int)
        inside = ((k >= 0) & (k < shape)).all(axis=0)
        v = a[tuple(np.clip(k, 0, shape - 1))]
        return v if outside == "border" else np.where(inside, v, 0.0)
    low = np.floor(at).astype(int)
    frac = at - low
    out = np.zeros(at.shape[1])
    for corner in range(1 << a.ndim):
        bits = np.array([corner >> d & 1 for d in range(a.ndim)])[:, None]
        w = np.where(bits, frac, 1 - frac).prod(axis=0)
        k = low + bits
        v = a[tuple(np.clip(k, 0, shape - 1))]
        if outside == "zeros":
            v = np.where(((k >= 0) & (k < shape)).all(axis=0), v, 0.0)
        out += w * v
    return out


def affine(matrix: np.ndarray, shape: Sequence[int] | None = None, mode: str = "linear", outside: str = "zeros") -> Kernel:
    """Output position p takes the value at matrix x p (homogeneous)."""

    def f(a):
        size = tuple(shape or a.shape)
        grid = np.stack(np.meshgrid(*map(np.arange, size), indexing="ij")).reshape(a.ndim, -1)
        at = matrix[: a.ndim, : a.ndim] @ grid + matrix[: a.ndim, -1:]
        return sample(a, at, mode, outside).reshape(size)

    return f


def resize(size: Sequence[int], mode: str = "linear") -> Kernel:
    """Half-pixel centred resizing."""

    def f(a):
        scale = np.array(a.shape) / np.array(size)
        m = np.eye(a.ndim + 1)
        m[: a.ndim, : a.ndim] = np.diag(scale)
        m[: a.ndim, -1] = (scale - 1) / 2
        return affine(m, size, mode, "border")(a)

    return f


def zoom(factor: float, mode: str = "linear") -> Kernel:
    return lambda a: resize([max(1, int(n * factor)) for n in a.shape], mode)(a)


def rotate(angle: float, mode: str = "linear") -> Kernel:
    """Two axes about the centre; the shape stays."""

    def f(a):
        c, s = math.cos(angle), math.sin(angle)
        mid = (np.array(a.shape) - 1) / 2
        m = np.eye(3)
        m[:2, :2] = [[c, -s], [s, c]]
        m[:2, 2] = mid - m[:2, :2] @ mid
        return affine(m, None, mode)(a)

    return f


def warp(field: np.ndarray, mode: str = "linear") -> Kernel:
    """Each position takes the value at itself plus a displacement (axes x shape)."""

    def f(a):
        grid = np.stack(np.meshgrid(*map(np.arange, a.shape), indexing="ij")).astype(float) + field
        return sample(a, grid.reshape(a.ndim, -1), mode).reshape(a.shape)

    return f


# Filters and intensities.


def convolve_axis(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis, zeros outside."""
    half = len(weights) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (half, len(weights) - 1 - half)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad), len(weights), axis)
    return windows @ weights


def gaussian_weights(sigma: float, truncated: float = 4.0) -> np.ndarray:
    """Shares of a normal distribution in cells of width 1 around 0, out to ``truncated`` deviations (rounded half up, one cell at least).

    A cell's share is the difference of the distribution function at its borders.
    """
    if sigma <= 0:
        return np.ones(1)
    cells = max(int(math.floor(truncated * sigma + 0.5)), 1)
    normal = NormalDist(0, sigma)
    below = np.array([normal.cdf(k - 0.5) for k in range(-cells, cells + 2)])
    return np.diff(below)


def gaussian_smooth(sigma: float) -> Kernel:
    def f(a):
        for axis in range(a.ndim):
            a = convolve_axis(a, gaussian_weights(sigma), axis)
        return a

    return f


def gaussian_sharpen(sigma1: float = 3.0, sigma2: float = 1.0, alpha: float = 30.0) -> Kernel:
    def f(a):
        b = gaussian_smooth(sigma1)(a)
        return b + alpha * (b - gaussian_smooth(sigma2)(b))

    return f


def median_filter(radius: int) -> Kernel:
    def f(a):
        w = np.lib.stride_tricks.sliding_window_view(np.pad(a, radius, "edge"), [2 * radius + 1] * a.ndim)
        return np.median(w.reshape(*a.shape, -1), axis=-1)

    return f


def mean_filter(size: int) -> Kernel:
    def f(a):
        for axis in range(a.ndim):
            a = convolve_axis(a, np.full(size, 1 / size), axis)
        return a

    return f


def sobel(axis: int) -> Kernel:
    def f(a):
        for k in range(a.ndim):
            a = convolve_axis(a, np.array([-1.0, 0, 1]) if k == axis else np.array([1.0, 2, 1]), k)
        return a

    return f


def laplace() -> Kernel:
    return lambda a: sum(convolve_axis(a, np.array([1.0, -2, 1]), k) for k in range(a.ndim))


def gamma(value: float) -> Kernel:
    def f(a):
        lo, span = a.min(), a.max() - a.min()
        return ((a - lo) / (span + 1e-7)) ** value * span + lo

    return f


def histogram_shift(points: Sequence[tuple[float, float]]) -> Kernel:
    """Piecewise linear map through control points on [0, 1] of the value range."""

    def f(a):
        lo, hi = a.min(), a.max()
        x, y = np.array(sorted(points)).T
        return a if hi == lo else np.interp(a, x * (hi - lo) + lo, y * (hi - lo) + lo)

    return f


def gibbs(alpha: float) -> Kernel:
    """Low-pass: frequencies further from the origin than a share (1 - alpha) of the longest axis' half diagonal are dropped."""

    def f(a):
        spectrum = np.fft.fftshift(np.fft.fftn(a))
        axes = [np.arange(n) - (n - 1) / 2 for n in a.shape]
        squared = sum(np.square(x).reshape([-1 if k == i else 1 for k in range(a.ndim)]) for i, x in enumerate(axes))
        half_diagonal = math.hypot(max(a.shape) / 2, max(a.shape) / 2)
        spectrum[squared > ((1 - alpha) * half_diagonal) ** 2] = 0
        return np.fft.ifftn(np.fft.ifftshift(spectrum)).real

    return f


def fft_centered(a: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Orthonormal Fourier transform with the origin in the middle."""
    f = np.fft.ifftn if inverse else np.fft.fftn
    return np.fft.fftshift(f(np.fft.ifftshift(a), norm="ortho"))


def bias_field(coefficients: Sequence[float], degree: int) -> Kernel:
    """Multiply by the exponential of a Legendre polynomial field."""

    def f(a):
        axes = [np.polynomial.legendre.legvander(np.linspace(-1, 1, n), degree) for n in a.shape]
        field, k = np.zeros(a.shape), 0
        for powers in np.ndindex(*[degree + 1] * a.ndim):
            if sum(powers) <= degree and k < len(coefficients):
                term = np.ones(())
                for ax, p in zip(axes, powers, strict=True):
                    term = np.multiply.outer(term, ax[:, p])
                field, k = field + coefficients[k] * term, k + 1
        return a * np.exp(field)

    return f


# Labels and shapes.


def erode(a: np.ndarray, radius: int = 1) -> np.ndarray:
    for axis in range(a.ndim):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (radius, radius)
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=np.inf), 2 * radius + 1, axis).min(axis=-1)
    return a


def dilate(a: np.ndarray, radius: int = 1) -> np.ndarray:
    return -erode(-a, radius)


def label_contour(a: np.ndarray) -> np.ndarray:
    """Labels at cells that touch another label."""
    return np.where(erode(a) != dilate(a), a, 0)


def components(mask: np.ndarray, full: bool = False) -> np.ndarray:
    """Connected components of true cells, numbered from 1 in scan order; neighbours by faces, or by corners too."""
    mask = np.asarray(mask, bool)
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [s for s in np.ndindex(*[3] * mask.ndim) if any(x != 1 for x in s) and (full or sum(x != 1 for x in s) == 1)]
    while True:
        new = label.copy()
        big = np.pad(np.where(mask, label, mask.size + 1), 1, constant_values=mask.size + 1)
        for s in steps:
            new = np.minimum(new, big[tuple(slice(x, x + n) for x, n in zip(s, mask.shape, strict=True))])
        new = np.where(mask, new, 0)
        root = np.concatenate([[0], new.ravel()])  # the label of the cell that a label names
        new = np.where(mask, np.minimum(new, root[new]), 0)
        if (new == label).all():
            break
        label = new
    _, number = np.unique(label, return_inverse=True)
    return number.reshape(mask.shape) + (0 if (label == 0).any() else 1)


def keep_largest(k: int = 1, full: bool = True) -> Kernel:
    """The k largest components; of equal sizes the one numbered higher."""

    def f(a):
        n = components(a > 0, full)
        size = np.bincount(n.ravel())[1:]
        if len(size) <= k:
            return a
        best = np.argsort(size, kind="stable")[::-1][:k] + 1
        return np.where(np.isin(n, best), a, 0)

    return f


def remove_small(least: int, full: bool = False) -> Kernel:
    def f(a):
        if len(np.unique(a)) == 1:
            return a
        n = components(a > 0, full)
        size = np.bincount(n.ravel())
        return np.where(size[n] >= least, a, 0)

    return f


def fill_holes(a: np.ndarray) -> np.ndarray:
    """Background that no path joins to the border becomes foreground."""
    outside = components(np.pad(a <= 0, 1, constant_values=True))
    inner = outside[tuple(slice(1, -1) for _ in a.shape)]
    return np.where((a <= 0) & (inner != outside.flat[0]), 1, a)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each true cell to the nearest false one, axis by axis on squared distances."""
    far = float(sum(n * n for n in mask.shape) + 1)
    d = np.where(mask, far, 0.0)
    for axis in range(mask.ndim):
        n = mask.shape[axis]
        gap = (np.arange(n)[:, None] - np.arange(n)[None, :]) ** 2
        d = np.moveaxis((np.moveaxis(d, axis, -1)[..., None, :] + gap).min(axis=-1), -1, axis)
    return np.sqrt(np.minimum(d, far))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 1.0, k1: float = 0.01, k2: float = 0.03) -> float:
    """Mean structural similarity with a uniform window, valid positions only."""
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, [window] * a.ndim).reshape(-1, window**a.ndim)
    x, y = view(a), view(b)
    mx, my = x.mean(axis=1), y.mean(axis=1)
    vx, vy, cxy = (x * x).mean(axis=1) - mx**2, (y * y).mean(axis=1) - my**2, (x * y).mean(axis=1) - mx * my
    c1, c2 = (k1 * span) ** 2, (k2 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * cxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def multiscale_ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 1.0, weights: Sequence[float] = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333), k1: float = 0.01, k2: float = 0.03) -> float:
    """Structural similarity over scales, each the means of 2 x 2 (x 2) cells of the one before: contrast terms of all but the last, the whole similarity there, as weighted powers; negative terms count as zero."""
    out = 1.0
    for k, w in enumerate(weights):
        view = lambda x: np.lib.stride_tricks.sliding_window_view(x, [window] * a.ndim).reshape(-1, window**a.ndim)  # noqa: E731, B023
        x, y = view(a), view(b)
        mx, my = x.mean(axis=1), y.mean(axis=1)
        vx, vy, cxy = (x * x).mean(axis=1) - mx**2, (y * y).mean(axis=1) - my**2, (x * y).mean(axis=1) - mx * my
        term = (2 * cxy + (k2 * span) ** 2) / (vx + vy + (k2 * span) ** 2)
        if k == len(weights) - 1:
            term = term * (2 * mx * my + (k1 * span) ** 2) / (mx**2 + my**2 + (k1 * span) ** 2)
        out *= max(float(term.mean()), 0.0) ** w
        half = [n // 2 for n in a.shape]
        pool = lambda z: z[tuple(slice(0, 2 * h) for h in half)].reshape([v for h in half for v in (h, 2)]).mean(axis=tuple(range(1, 2 * len(half), 2)))  # noqa: E731, B023
        if k < len(weights) - 1:
            a, b = pool(a), pool(b)
    return out


def otsu(a: np.ndarray, bins: int = 256) -> float:
    """Threshold of the largest variance between classes."""
    n, edges = np.histogram(a, bins)
    mid, total = (edges[:-1] + edges[1:]) / 2, n.sum()
    w = np.cumsum(n)
    m = np.cumsum(n * mid)
    ok = (w > 0) & (w < total)
    between = np.where(ok, (m[-1] * w - m * total) ** 2 / np.where(ok, w * (total - w), 1), -1)
    return float(mid[int(between.argmax())])


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost of rows with columns (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        return sorted((j, i) for i, j in assign(cost.T))
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            done[j0] = True
            r = match[j0]
            slack = np.where(done[1:], np.inf, cost[r - 1] - u[r] - v[1:])
            better = slack < least[1:]
            least[1:][better], back[1:][better] = slack[better], j0
            j1 = int(np.where(done, np.inf, np.where(np.arange(m + 1) == 0, np.inf, least)).argmin())
            step = least[j1]
            u[match[done]] += step
            v[done] -= step
            least[~done] -= step
            j0 = j1
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def spacing(matrix: np.ndarray) -> np.ndarray:
    """Voxel sizes of an affine: lengths of its columns, zeros as 1."""
    s = np.sqrt((matrix[:-1, :-1] ** 2).sum(axis=0))
    s[s == 0] = 1
    return s


def flip_handedness(matrix: np.ndarray) -> np.ndarray:
    """Between the two patient orientations that differ in the sign of the first two axes."""
    d = np.eye(len(matrix))
    d[0, 0] = -1
    if len(matrix) > 2:
        d[1, 1] = -1
    return d @ matrix
