"""Fast Fourier transforms of complex arrays (see ``complexes``) in the JVM, for any length and any number of axes.

A length is split into its factors. Each factor is one pass over the array (self-sorting, so no cells
are put back in order at the end), and a pass of factor r takes r products a cell: n times the sum of the
factors in all, n log n for lengths of small factors. The roots of unity are one table, which the
optimizer folds to a constant. Sizes are numbers of the plan. Wavelets are transformed batch by batch by numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions.arrays import bind


def factors(n: int) -> list[int]:
    """Prime factors of a length, two twos as a four: fewer passes, the same work."""
    out, p = [], 2
    while n % 4 == 0 and n:
        out.append(4)
        n //= 4
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out


def _roots(n: int, sign: float) -> Column:
    angle = lambda t: sign * 2 * math.pi / n * t
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.struct(F.cos(angle(t)).alias("re"), F.sin(angle(t)).alias("im")))


def _along(a: Column, total: int, n: int, inner: int, sign: float, scale: float) -> Column:
    """The transform along an axis of size n, with ``inner`` cells for each step on it."""
    if n == 1:
        return a

    def passes(w: Column) -> Column:
        out, done, left = a, 1, n
        steps = factors(n)
        for nth, r in enumerate(steps):
            left //= r
            last = scale if nth == len(steps) - 1 else 1.0
            out = bind(out, one_pass(w, r, done, left, last))
            done *= r
        return out

    def one_pass(w: Column, *how):
        return lambda x: F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: _cell(x, w, i, *how))

    def _cell(x: Column, w: Column, i: Column, r: int, done: int, left: int, last: float) -> Column:
        # Cell (block, k, p, j, s) of the result is a sum over the cells (block, q, k, j, s) of the array before.
        stretch = done * inner
        js, p = i % stretch, F.floor(i / stretch) % r
        k, block = F.floor(i / (stretch * r)) % left, F.floor(i / (stretch * r * left))
        re, im = [], []
        for q in range(r):
            z = x[(((block * r + q) * left + k) * stretch + js).cast("int")]
            t = (p * (q * (n // r)) + p * k * done) % n
            root = w[t.cast("int")]
            re.append(z["re"] * root["re"] - z["im"] * root["im"])
            im.append(z["re"] * root["im"] + z["im"] * root["re"])
        add = lambda xs: reduce(Column.__add__, xs) * last if last != 1.0 else reduce(Column.__add__, xs)
        return F.struct(add(re).alias("re"), add(im).alias("im"))

    return bind(_roots(n, sign), passes)


def fftn(a: Column, shape: Sequence[int], axes: Sequence[int] | None = None, inverse: bool = False, ortho: bool = True) -> Column:
    """The transform of an array of a shape (row-major) along some axes (all by default); orthonormal, or with 1 / n on the way back only."""
    total = math.prod(shape)
    if total == 0:
        return a
    step = lambda *how: lambda x: _along(x, total, how[0], how[1], 1.0 if inverse else -1.0, how[2])
    out = a
    for axis in range(len(shape)) if axes is None else [x % len(shape) for x in axes]:
        n = shape[axis]
        scale = 1 / math.sqrt(n) if ortho else 1 / n if inverse else 1.0
        out = bind(out, step(n, math.prod(shape[axis + 1 :]), scale))
    return out


def fft(a: Column, n: int, inverse: bool = False, ortho: bool = True) -> Column:
    return fftn(a, (n,), None, inverse, ortho)


def shifted(a: Column, shape: Sequence[int], back: bool = False) -> Column:
    """The first cell of each axis moved to its middle, or back."""
    from stratalens.functions.nd import Nd

    return bind(a, lambda x: Nd(x, tuple(shape)).shift_frequencies(back=back).data)


def centered(a: Column, shape: Sequence[int], axes: Sequence[int] | None = None, inverse: bool = False) -> Column:
    """The orthonormal transform with the origin in the middle on both sides."""
    from stratalens.functions.nd import Nd

    moved = lambda x, back: bind(x, lambda y: Nd(y, tuple(shape)).shift_frequencies(axes, back).data)
    return moved(fftn(moved(a, True), shape, axes, inverse), False)


def mexican_hat(width: float) -> list[float]:
    """The wavelet at whole places out to eight widths, of unit energy."""
    reach = math.ceil(8 * width)
    norm = 2 / (math.sqrt(3 * width) * math.pi**0.25)
    return [norm * (1 - (t / width) ** 2) * math.exp(-((t / width) ** 2) / 2) for t in range(-reach, reach + 1)]


def wavelets(signal: Column, n: int, widths: Sequence[float], wavelet=mexican_hat) -> Column:
    """The continuous wavelet transform of a real signal of n samples, zero beyond its ends: an array of coefficients for each width.

    A batch of signals is transformed at once; each width is a product in frequency and one transform back. No
    signal has no coefficients, and a signal with an empty sample null ones.
    """
    banks = [wavelet(float(w)) for w in widths]
    size = n + max(len(b) for b in banks) - 1
    size = 1 << (size - 1).bit_length()

    @F.arrow_udf("array<array<double>>")
    def coefficients(signals: pa.Array) -> pa.Array:
        lengths = np.diff(np.asarray(signals.offsets))
        flat = signals.flatten()
        lengths[np.asarray(signals.is_null())] = 0
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = place < size
        x = np.zeros((len(lengths), size))
        x[row[inside], place[inside]] = flat.to_numpy(zero_copy_only=False).astype(float)[inside]
        empty = np.zeros(len(lengths), bool)
        empty[row[inside & np.asarray(flat.is_null())]] = True
        spectrum = np.fft.rfft(x, axis=1)
        out = np.empty((len(lengths), len(banks), n))
        for k, b in enumerate(banks):
            out[:, k] = np.fft.irfft(spectrum * np.fft.rfft(b, size), size, axis=1)[:, len(b) // 2 : len(b) // 2 + n]
        values = pa.array(out.ravel(), mask=np.repeat(empty, len(banks) * n))
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) * len(banks) + 1, dtype=np.int32) * n), values)
        ends = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * len(banks))
        return pa.ListArray.from_arrays(ends, each, mask=signals.is_null())

    return coefficients(signal)
