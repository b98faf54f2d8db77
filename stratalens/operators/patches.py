"""Patches of arrays: positions, splitting, merging with weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_of(patch: int, overlap: float | int) -> int:
    """Step between patches: rounded half to even for a share, patch - overlap for a count."""
    return max(1, round(patch * (1 - overlap)) if isinstance(overlap, float) else patch - overlap)


def patch_starts(size: Column, patch: int, overlap: float | int = 0, padded: bool = False) -> Column:
    """Starts of the patches of an axis; without padding only those that fit."""
    end = size - 1 if padded else size - patch
    return F.when(end >= 0, F.sequence(F.lit(0), end, F.lit(step_of(patch, overlap)))).otherwise(F.array().cast("array<int>"))


def dense_starts(size: int, patch: int, step: int) -> list[int]:
    """Starts that cover an axis; the last window is moved back inside."""
    n = max(1, math.ceil((size - patch) / step) + 1)
    return [min(i * step, max(size - patch, 0)) for i in range(n)]


def split(df: DataFrame, array: str, patch: int, overlap: float | int = 0) -> DataFrame:
    """One row for each patch: start and values."""
    return df.withColumn("start", F.explode(patch_starts(F.size(array), patch, overlap))).withColumn("patch", F.slice(F.col(array), F.col("start") + 1, F.lit(patch)))


def gaussian_weights(patch: int, sigma_scale: float = 0.125) -> list[float]:
    sigma, mid = sigma_scale * patch, (patch - 1) / 2
    w = [math.exp(-((i - mid) ** 2) / (2 * sigma * sigma)) for i in range(patch)]
    return [x / max(w) for x in w]


def merge(df: DataFrame, by: list[str], weights: list[float] | None = None) -> DataFrame:
    """Weighted average of overlapping patches (start, patch) at each position."""
    cells = df.select(*by, "start", F.posexplode("patch").alias("i", "x"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("i") + 1) if weights else F.lit(1.0)
    return cells.withColumn("w", w).groupBy(*by, (F.col("start") + F.col("i")).alias("position")).agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"))


def top_patches(df: DataFrame, by: list[str], n: int, score: Column, largest: bool = True) -> DataFrame:
    """The n best patches of each group; ties by start."""
    order = [score.desc() if largest else score.asc(), F.col("start")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
