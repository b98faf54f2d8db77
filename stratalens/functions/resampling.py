"""Affine resampling of dense arrays in the JVM: pending matrices composed as columns, one gather at the end.

An array is a column of values (row-major) and a column of its shape. A matrix is an array column of
``dims`` rows of ``dims + 1`` numbers (the last row of the homogeneous matrix is implied) and takes a cell of
the *result* to a place in the *source*. So steps compose by a product, undo by an inverse, and
only ``gather`` touches values, however many steps are pending. Places outside the source give ``fill``
(or, with ``border``, the nearest cell's value). ``nearest`` rounds halves up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product as every

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(f: Callable[..., Column], *cols: Column) -> Column:
    """f of columns that are evaluated once, however often f uses them."""
    return F.transform(F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])), lambda s: f(*[s[f"c{i}"] for i in range(len(cols))]))[0]


def matrix(rows: Sequence[Sequence[Column | float]]) -> Column:
    """A matrix column from dims rows of dims + 1 numbers or columns."""
    return F.array(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for r in rows for x in r])


def identity(dims: int) -> Column:
    return matrix([[float(i == j) for j in range(dims + 1)] for i in range(dims)])


def _at(m: Column, i: int, j: int, dims: int) -> Column:
    return m[i * (dims + 1) + j]


def compose(first: Column, second: Column, dims: int) -> Column:
    """The matrix of a step after another: result of the second -> result of the first -> source."""

    def made(a: Column, b: Column) -> Column:
        cell = lambda i, j: reduce(Column.__add__, [_at(a, i, k, dims) * _at(b, k, j, dims) for k in range(dims)])
        return matrix([[cell(i, j) + (_at(a, i, j, dims) if j == dims else 0) for j in range(dims + 1)] for i in range(dims)])

    return bind(made, first, second)


def inverse(m: Column, dims: int) -> Column:
    """The inverse of a matrix by cofactors; null if it has none."""

    def det(a: list[list[Column]]) -> Column:
        if len(a) == 1:
            return a[0][0]
        return reduce(Column.__add__, [(a[0][j] if j % 2 == 0 else -a[0][j]) * det([r[:j] + r[j + 1 :] for r in a[1:]]) for j in range(len(a))])

    def made(x: Column) -> Column:
        a = [[_at(x, i, j, dims) for j in range(dims)] for i in range(dims)]

        def cofactor(i: int, j: int) -> Column:
            if dims == 1:
                return F.lit(1.0)
            minor = det([r[:j] + r[j + 1 :] for k, r in enumerate(a) if k != i])
            return minor if (i + j) % 2 == 0 else -minor

        linear = bind(lambda d: F.when(d != 0, F.array(*[cofactor(j, i) / d for i in range(dims) for j in range(dims)])), det(a))
        return bind(lambda v: F.when(v.isNotNull(), matrix([[*[v[i * dims + j] for j in range(dims)], -reduce(Column.__add__, [v[i * dims + j] * _at(x, j, dims, dims) for j in range(dims)])] for i in range(dims)])), linear)

    return bind(made, m)


def apply_to_points(m: Column, points: Column, dims: int) -> Column:
    """Points (array of arrays) taken by a matrix, as from voxels to the world and back."""
    return bind(lambda a, ps: F.transform(ps, lambda p: F.array(*[reduce(Column.__add__, [_at(a, i, j, dims) * p[j] for j in range(dims)]) + _at(a, i, dims, dims) for i in range(dims)])), m, points)


def gather(data: Column, shape: Column, m: Column, target: Column, dims: int, mode: str = "nearest", fill: float = 0.0, border: bool = False, displacement: Column | None = None) -> Column:
    """The array of shape ``target`` whose cells are the source's at the places that the matrix gives.

    ``displacement`` (dims x cells of the target, row-major) is added to the places, in source cells.
    """
    if mode not in ("nearest", "linear"):
        raise ValueError("mode is nearest or linear")

    def made(v: Column, n: Column, a: Column, size: Column, *moved: Column) -> Column:
        total = reduce(Column.__mul__, [size[k] for k in range(dims)])

        def read(at: Sequence[Column]) -> Column:
            if border:
                at = [F.least(F.greatest(c, F.lit(0)), n[k] - 1) for k, c in enumerate(at)]
            place = reduce(lambda acc, k: acc * n[k] + at[k], range(1, dims), at[0])
            value = v[place.cast("int")]
            return value if border else F.when(reduce(Column.__and__, [(c >= 0) & (c < n[k]) for k, c in enumerate(at)]), value).otherwise(F.lit(fill))

        def cell(i: Column) -> Column:
            own, rest = [], i
            for k in reversed(range(dims)):
                own.append(rest % size[k])
                rest = F.floor(rest / size[k])
            own = own[::-1]
            places = []
            for k in range(dims):
                x = reduce(Column.__add__, [_at(a, k, j, dims) * own[j] for j in range(dims)]) + _at(a, k, dims, dims)
                places.append(x + moved[0][(total * k + i).cast("int")] if moved else x)
            if mode == "nearest":
                return bind(lambda *at: read(at), *[F.floor(x + 0.5) for x in places])

            def mixed(*at: Column) -> Column:
                low = [F.floor(x) for x in at]
                parts = []
                for corner in every((0, 1), repeat=dims):
                    weight = reduce(Column.__mul__, [(x - lo) if c else (1 - (x - lo)) for x, lo, c in zip(at, low, corner, strict=True)])
                    # A corner of no weight counts nothing, whatever stands there.
                    parts.append(F.when(weight > 0, weight * read([lo + c for lo, c in zip(low, corner, strict=True)])).otherwise(0.0))
                return reduce(Column.__add__, parts)

            return bind(mixed, *places)

        return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), cell)).otherwise(F.slice(v, 1, 0))

    return bind(made, data, shape, m, target, *([displacement] if displacement is not None else []))


def _of_rows(column: pa.Array, dims: int) -> np.ndarray:
    """Arrays of a row as a row of numbers, NaN where there is none or a shorter one."""
    out = np.full((len(column), dims), np.nan)
    flat, off = np.asarray(column.flatten().cast(pa.float64())), np.asarray(column.value_lengths().fill_null(0)).cumsum()
    for k in range(dims):
        at = np.diff(off, prepend=0) > k
        out[at, k] = flat[(off - np.diff(off, prepend=0))[at] + k]
    return out


def inverses(m: np.ndarray, dims: int) -> np.ndarray:
    """``inverse`` of a matrix a row, by the same operations in the same order; NaN where there is none."""
    at = lambda i, j: m[:, i * (dims + 1) + j]

    def det(a):
        if len(a) == 1:
            return a[0][0]
        return reduce(np.add, [(a[0][j] if j % 2 == 0 else -a[0][j]) * det([r[:j] + r[j + 1 :] for r in a[1:]]) for j in range(len(a))])

    a = [[at(i, j) for j in range(dims)] for i in range(dims)]

    def cofactor(i, j):
        if dims == 1:
            return np.ones(len(m))
        minor = det([r[:j] + r[j + 1 :] for k, r in enumerate(a) if k != i])
        return minor if (i + j) % 2 == 0 else -minor

    d = det(a)
    d = np.where(d == 0, np.nan, d)
    v = [cofactor(j, i) / d for i in range(dims) for j in range(dims)]
    rows = [[*v[i * dims : (i + 1) * dims], -reduce(np.add, [v[i * dims + j] * at(j, dims) for j in range(dims)])] for i in range(dims)]
    return np.stack([x for r in rows for x in r], axis=1)


def read_cells(cell: np.ndarray, row: np.ndarray, shape: np.ndarray, m: np.ndarray, size: np.ndarray, dims: int) -> np.ndarray:
    """For cells of the rows' targets (``cell`` is a number in its row's target) the number of the nearest source cell in its row, -1 outside; the operations are those of ``gather``."""
    own, rest = [], cell
    n = size.astype(np.int64)
    for k in reversed(range(dims)):
        rest, x = np.divmod(rest, n[row, k])
        own.append(x.astype(float))
    own = own[::-1]
    source, ok = np.zeros(len(cell)), np.ones(len(cell), bool)
    for k in range(dims):
        x = reduce(np.add, [m[row, k * (dims + 1) + j] * own[j] for j in range(dims)]) + m[row, k * (dims + 1) + dims]
        x = np.floor(x + 0.5)
        most = shape[row, k]
        ok &= (x >= 0) & (x < most)
        source = source * most + x
    return np.where(ok, source, -1).astype(np.int64)


def _lists(data: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values, first of each row, how many)."""
    n = np.asarray(data.value_lengths().fill_null(0)).astype(np.int64)
    return data.flatten(), np.cumsum(n) - n, n


def restored_rows(data: pa.Array, shape: pa.Array, matrices: pa.Array, before: pa.Array, dims: int, fill: float) -> pa.Array:
    """Arrays taken back through the steps of their rows' traces (matrices and shapes before, one behind another), the last step first; a row without steps stays as it is."""
    values, first, n = _lists(data)
    absent = np.asarray(data.is_null())
    now = _of_rows(shape, dims)
    m_of, m_first, steps = _lists(matrices)
    m_all = _of_rows(m_of, dims * (dims + 1))
    b_of, b_first, _ = _lists(before)
    b_all = _of_rows(b_of, dims)
    # Each row's places are carried from its first array backwards, so values move once.
    at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    for back in range(int(steps.max(initial=0))):
        here = np.flatnonzero(steps > back)
        step = steps[here] - 1 - back
        m, target = inverses(m_all[m_first[here] + step], dims), b_all[b_first[here] + step]
        size = np.nan_to_num(np.prod(target, axis=1)).astype(np.int64)
        row = np.repeat(np.arange(len(here)), size)
        cell = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        source = read_cells(cell, row, now[here], m, target, dims)
        if (source >= n[here][row]).any() and not absent[here][row[source >= n[here][row]]].all():
            raise ValueError("an array has fewer cells than its shape says")
        begin = np.cumsum(n) - n
        new_n = n.copy()
        new_n[here] = size
        new = np.empty(int(new_n.sum()), np.int64)
        new_begin = np.cumsum(new_n) - new_n
        stay = np.flatnonzero(steps <= back)
        if len(stay):
            k = np.arange(int(n[stay].sum())) - np.repeat(np.cumsum(n[stay]) - n[stay], n[stay])
            new[np.repeat(new_begin[stay], n[stay]) + k] = at[np.repeat(begin[stay], n[stay]) + k]
        # -1 is outside; -2 a cell of an array that is null.
        got = np.full(len(source), -1)
        inside = source >= 0
        gone = inside & absent[here][row]
        take = inside & ~gone
        got[take] = at[(begin[here][row] + source)[take]]
        got[gone] = -2
        new[np.repeat(new_begin[here], size) + cell] = got
        at, n = new, new_n
        absent[here] = False
        now[here] = target
    made = values.cast(pa.float64()).take(pa.array(np.maximum(at, 0), mask=at < 0))
    made = pc.if_else(pa.array(at == -1), pa.scalar(float(fill)), made)
    off = np.append(np.cumsum(n) - n, n.sum()).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, mask=np.append(absent, False)), made)


def gathered_rows(data: pa.Array, shape: pa.Array, m: pa.Array, size: pa.Array, cells: pa.Array, dims: int, fill: float) -> pa.Array:
    """The given cells of each row's target, as ``gather`` reads the nearest ones."""
    values, first, n = _lists(data)
    cell, _, many = _lists(cells)
    row = np.repeat(np.arange(len(data)), many)
    source = read_cells(np.asarray(cell).astype(np.int64), row, _of_rows(shape, dims), _of_rows(m, dims * (dims + 1)), np.nan_to_num(_of_rows(size, dims)), dims)
    absent = np.asarray(data.is_null())
    if ((source >= n[row]) & ~absent[row]).any():
        raise ValueError("an array has fewer cells than its shape says")
    made = values.cast(pa.float64()).take(pa.array(np.maximum(first[row] + source, 0), mask=(source < 0) | absent[row]))
    made = pc.if_else(pa.array(source < 0), pa.scalar(float(fill)), made)
    off = np.append(np.cumsum(many) - many, many.sum()).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, mask=np.append(absent & (many == 0), False)), made)


def gather_rows(data: Column, shape: Column, m: Column, target: Column, dims: int, fill: float = 0.0) -> Column:
    """``gather`` of the nearest cells by numpy, for many rows at once."""
    run = F.arrow_udf(lambda d, s, a, n, c: gathered_rows(d, s, a, n, c, dims, fill), "array<double>")
    total = reduce(Column.__mul__, [target[k] for k in range(dims)])
    cells = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return run(data.cast("array<double>"), shape.cast("array<int>"), m, target, cells)


def restore(data: Column, shape: Column, matrices: Column, before: Column, dims: int, fill: float = 0.0) -> Column:
    """``restored_rows`` as a column: nothing in a row but its own arrays is read, so batches are any rows."""
    run = F.arrow_udf(lambda d, s, m, b: restored_rows(d, s, m, b, dims, fill), "array<double>")
    return run(data.cast("array<double>"), shape.cast("array<int>"), matrices, before)


def match_matrix(source_affine: Column, target_affine: Column, dims: int) -> Column:
    """From cells of a target grid to cells of a source, through the world that both affines (cell -> world) share."""
    return compose(inverse(source_affine, dims), target_affine, dims)


def resample_to_match(data: Column, shape: Column, affine: Column, target_shape: Column, target_affine: Column, dims: int, mode: str = "linear", fill: float = 0.0, border: bool = False) -> Column:
    """An image on another image's grid."""
    return gather(data, shape, match_matrix(affine, target_affine, dims), target_shape, dims, mode, fill, border)
