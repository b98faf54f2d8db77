"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import forget, materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the least node that it reaches.

    Each round is written to the shared folder. When a round changes nothing, every node hangs on its
    component's least one; that takes rounds in the order of the logarithm of the largest diameter.
    """
    e = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        before, mark = e, now
        e = materialise(_small_star(_large_star(before)), "edges")
        forget(before)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._written = e._written  # forget() of the result deletes the last round
    return out
