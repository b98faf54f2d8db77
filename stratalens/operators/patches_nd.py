"""Patches of dense arrays in any number of dimensions: grids, windows, weighted merges, and windows through a user's function."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.functions.nd import Nd, product, ravel_index, unravel_index
from stratalens.operators.patches import dense_starts, step_of


def grid_starts(shape: Sequence[int], patch: Sequence[int], overlap: float | int = 0, padded: bool = False, offset: Sequence[int] | None = None) -> list[list[int]]:
    """Starts of the patches of a grid, last axis fastest; without padding only those that fit."""
    first = offset or [0] * len(shape)
    return [list(s) for s in itertools.product(*[range(o, n if padded else n - p + 1, step_of(p, overlap)) for n, p, o in zip(shape, patch, first, strict=True)])]


def window_starts(shape: Sequence[int], patch: Sequence[int], overlap: float = 0.25) -> list[list[int]]:
    """Starts of windows that cover an array; the last ones are moved back inside."""
    steps = [n if p >= n else max(1, int(p * (1 - overlap))) for n, p in zip(shape, patch, strict=True)]
    return [list(s) for s in itertools.product(*[dense_starts(n, p, k) for n, p, k in zip(shape, patch, steps, strict=True)])]


def split(df: DataFrame, data: str, shape: Sequence[int], patch: Sequence[int], starts: Sequence[Sequence[int]], fill: float = 0.0) -> DataFrame:
    """One row for each patch: ``start`` (array) and ``patch`` (values); cells outside the array are ``fill``."""
    listed = F.array(*[F.array(*map(F.lit, s)) for s in starts])
    rows = df.withColumn("start", F.explode(listed))
    x = Nd(F.col(data), tuple(shape))
    outside = any(s + p > n or s < 0 for st in starts for s, p, n in zip(st, patch, shape, strict=True))

    def source(at: list[Column]):
        own = [c + F.col("start")[k] for k, c in enumerate(at)]
        inside = None
        if outside:
            for c, n in zip(own, shape, strict=True):
                ok = (c >= 0) & (c < n)
                inside = ok if inside is None else inside & ok
        return own, inside

    return rows.withColumn("patch", x.gather(patch, source, fill).data)


def importance(patch: Sequence[int], mode: str = "gaussian", sigma_scale: float = 0.125, floor: float = 1e-3) -> list[float]:
    """Weights of a patch's cells: equal, or a bell curve about its middle with the largest weight 1 and none below ``floor``."""
    if mode == "constant":
        return [1.0] * math.prod(patch)
    axes = [[math.exp(-((i - (p - 1) / 2) ** 2) / (2 * (sigma_scale * p) ** 2)) for i in range(p)] for p in patch]
    w = [math.prod(x) for x in itertools.product(*axes)]
    return [max(x / max(w), floor) for x in w]


def merge(patches: DataFrame, by: Sequence[str], patch: Sequence[int], shape: Sequence[int], weights: Sequence[float] | None = None) -> DataFrame:
    """``by``, cell, value: the weighted mean of all patches (start, patch) over each cell of the array; overlapping ones combine before they move."""
    cells = patches.select(*by, "start", F.posexplode("patch").alias("i", "x"))
    at = [c + F.col("start")[k] for k, c in enumerate(unravel_index(F.col("i"), patch))]
    inside = None
    for c, n in zip(at, shape, strict=True):
        ok = (c >= 0) & (c < n)
        inside = ok if inside is None else inside & ok
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("i") + 1) if weights else F.lit(1.0)
    cells = cells.where(inside).withColumn("w", w).withColumn("cell", ravel_index(at, shape).cast("int"))
    return cells.groupBy(*by, "cell").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"))


def infer(df: DataFrame, data: str, by: Sequence[str], shape: Sequence[int], patch: Sequence[int], predict: Callable, overlap: float = 0.25, mode: str = "constant") -> DataFrame:
    """Sliding-window inference: ``predict`` maps arrays of patches (windows x patch) to arrays of the same shape, many windows a call; the results are merged.

    The windows of a record are rows of their own, so they spread over tasks.
    """
    import numpy as np
    import pyarrow as pa

    rows = split(df, data, shape, patch, window_starts(shape, patch, overlap)).select(*by, "start", "patch")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array(batch.column("patch").to_pylist(), float).reshape(-1, *patch)
            y = np.asarray(predict(x), float).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "start")), pa.array(y.tolist(), pa.list_(pa.float64()))], [*by, "start", "patch"])

    kinds = dict(rows.dtypes)
    done = rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "start array<int>", "patch array<double>"]))
    return merge(done, by, patch, shape, importance(patch, mode) if mode != "constant" else None)


def top(patches: DataFrame, by: Sequence[str], n: int, score: Column, largest: bool = True) -> DataFrame:
    """The n best patches of each record, ties by start."""
    order = score.desc() if largest else score.asc()
    return patches.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "start"))).where(F.col("rank") <= n)


def rand_grid(df: DataFrame, data: str, key: str, shape: Sequence[int], patch: Sequence[int], overlap: float | int = 0, seed: int = 0) -> DataFrame:
    """Patches of a grid that begins at a drawn offset, less than a patch on each axis; only those that fit."""
    room = [min(p, n - p + 1) for n, p in zip(shape, patch, strict=True)]
    rows = df
    x = Nd(F.col(data), tuple(shape))
    starts = None
    for k, (n, p, r) in enumerate(zip(shape, patch, room, strict=True)):
        axis = F.sequence(draws.below(key, r, seed, f"o{k}"), F.lit(n - p), F.lit(step_of(p, overlap)))
        starts = F.transform(axis, lambda s: F.array(s)) if starts is None else F.flatten(F.transform(starts, lambda a: F.transform(axis, lambda s: F.concat(a, F.array(s)))))  # noqa: B023
    rows = rows.withColumn("start", F.explode(starts))
    return rows.withColumn("patch", x.gather(patch, lambda at: ([c + F.col("start")[k] for k, c in enumerate(at)], None)).data)


def pad_collate(df: DataFrame, by: str, data: str, shape: str, dims: int, value: float = 0.0) -> DataFrame:
    """Arrays (data, shape) padded at their ends to the largest size of each axis in their batch, so that a batch stacks."""
    most = df.groupBy(by).agg(*[F.max(F.col(shape)[k]).alias(f"__m{k}") for k in range(dims)])
    x = df.join(most, by)
    old, new = [F.col(shape)[k] for k in range(dims)], [F.col(f"__m{k}") for k in range(dims)]

    def source(at: list[Column]):
        ok = None
        for c, n in zip(at, old, strict=True):
            ok = (c < n) if ok is None else ok & (c < n)
        return at, ok

    padded = Nd(F.col(data), tuple(old)).gather(new, source, value).data
    return x.withColumn(data, padded).withColumn(shape, F.array(*new)).drop(*[f"__m{k}" for k in range(dims)])


def cells_of(shape: Sequence[int]) -> int:
    return product(shape)
