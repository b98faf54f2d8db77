"""Pathology analytics on cell tables: detections against lesion labels, isolated cells, instance centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lesion_hits(detections: DataFrame, cells: DataFrame, image: str, at: Sequence[str], score: str, label: str, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(image, score of false positives; image, label, score of true positives: the best detection of each lesion).

    A detection takes the label of the cell it falls on; without one, or on 0, it is false. Detections on
    excluded lesions (image, label) count neither way.
    """
    on = detections.join(cells.select(image, *at, label), [image, *at], "left").withColumn(label, F.coalesce(label, F.lit(0)))
    if excluded is not None:
        on = on.join(excluded.select(image, label).distinct(), [image, label], "left_anti")
    false = on.where(F.col(label) == 0).select(image, score)
    true = on.where(F.col(label) != 0).groupBy(image, label).agg(F.max(score).alias(score))
    return false, true


def froc_table(false: DataFrame, true: DataFrame, score: str, n_images: int, n_targets: int) -> DataFrame:
    """threshold, fps, sensitivity from the scores of false and true positives."""
    from stratalens.operators.metrics import froc_curve

    rows = false.select(F.col(score).alias("score"), F.lit(0).alias("y")).unionByName(true.select(F.col(score).alias("score"), F.lit(1).alias("y")))
    return froc_curve(rows, n_images, n_targets)


def isolated_cells(cells: DataFrame, image: str, label: str, at: Sequence[str], extent: float) -> DataFrame:
    """Lesions (image, label) whose longest side is below an extent: isolated tumour cells."""
    sides = [F.max(a) - F.min(a) + 1 for a in at]
    return cells.where(F.col(label) != 0).groupBy(image, label).agg((F.greatest(*sides) if len(sides) > 1 else sides[0]).alias("extent")).where(F.col("extent") < extent)


def instance_centroids(cells: DataFrame, image: str, label: str, at: Sequence[str]) -> DataFrame:
    """Mean coordinates of each instance."""
    return cells.where(F.col(label) != 0).groupBy(image, label).agg(*[F.avg(a).alias(a) for a in at], F.count("*").alias("cells"))


def instance_borders(cells: DataFrame, image: str, label: str, x: str = "x", y: str = "y") -> DataFrame:
    """Cells of instances that have a neighbour (up, down, left, right) of another label or none."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    near = cells.withColumn("s", F.explode(steps)).select(image, label, (F.col(x) + F.col("s.dx")).alias(x), (F.col(y) + F.col("s.dy")).alias(y))
    covered = near.groupBy(image, label, x, y).agg(F.count("*").alias("n"))
    return cells.where(F.col(label) != 0).join(covered, [image, label, x, y], "left").where(F.coalesce("n", F.lit(0)) < 4).drop("n")


def hover_maps(cells: DataFrame, image: str, label: str, x: str = "x", y: str = "y") -> DataFrame:
    """Horizontal and vertical distance of each cell from its instance's centre, each side scaled to [-1, 1] by itself."""
    c = cells.where(F.col(label) != 0).groupBy(image, label).agg(*[f(a).alias(f"{n}_{a}") for a in (x, y) for n, f in (("mid", F.avg), ("lo", F.min), ("hi", F.max))])
    out = cells.where(F.col(label) != 0).join(c, [image, label])
    for a, name in ((x, "horizontal"), (y, "vertical")):
        d = F.col(a) - F.round(F.col(f"mid_{a}"))
        low, high = F.round(F.col(f"mid_{a}")) - F.col(f"lo_{a}"), F.col(f"hi_{a}") - F.round(F.col(f"mid_{a}"))
        out = out.withColumn(name, F.when((d < 0) & (low > 0), d / low).when((d > 0) & (high > 0), d / high).otherwise(F.lit(0.0)))
    return out.select(image, label, x, y, "horizontal", "vertical")
