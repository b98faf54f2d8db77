"""Test images as tables: bright balls on a dark ground, with the labels of their cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.functions.nd import unravel_index


def ball_images(spark: SparkSession, n: int, shape: Sequence[int], balls: int = 12, radius: tuple[int, int] = (5, 30), noise: float = 0.0, classes: int = 5, seed: int = 0) -> DataFrame:
    """image_id, data (values 0 to 1) and label (0 to ``classes``) as dense arrays of a shape; every number is a function of the seed and the image's number.

    Each ball has a drawn centre that keeps it inside, a radius and a class; a later ball covers an earlier
    one, and a cell's value is drawn with its ball, plus noise.
    """
    images = spark.range(n).withColumnRenamed("id", "image_id")
    key = lambda b: F.concat_ws("/", F.col("image_id"), F.lit(b))
    made = []
    for b in range(balls):
        r = draws.below(key(b), radius[1] - radius[0] + 1, seed, "r") + radius[0]
        mid = [F.floor(draws.unit(key(b), seed, f"c{k}") * F.greatest(F.lit(s) - 2 * r, F.lit(1))) + F.least(r, F.lit(s // 2)) for k, s in enumerate(shape)]
        made.append(F.struct(r.alias("r"), *[m.alias(f"m{k}") for k, m in enumerate(mid)], (draws.below(key(b), classes, seed, "l") + 1).alias("l"), (draws.unit(key(b), seed, "v") * 0.5 + 0.5).alias("v")))
    images = images.withColumn("balls", F.array(*made))

    def last(i):
        at = unravel_index(i, shape)

        def covers(s):
            return sum(((s[f"m{k}"] - c) * (s[f"m{k}"] - c) for k, c in enumerate(at)), F.lit(0)) <= s["r"] * s["r"]

        return F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("l"), F.lit(0.0).alias("v"))), F.transform(F.filter("balls", covers), lambda s: F.struct(s["l"].alias("l"), s["v"].alias("v")))), -1)

    cells = F.transform(F.sequence(F.lit(0), F.lit(math.prod(shape) - 1)), last)
    out = images.withColumn("cells", cells)
    value = F.transform("cells", lambda c, i: c["v"] + (draws.unit(F.concat_ws("/", F.col("image_id"), i), seed, "n") * noise if noise else F.lit(0.0)))
    return out.select("image_id", F.array(*map(F.lit, shape)).alias("shape"), value.alias("data"), F.transform("cells", lambda c: c["l"]).alias("label"))
