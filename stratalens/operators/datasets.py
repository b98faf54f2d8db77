"""Dataset operations on rows with an explicit order: index, partition, stratify, resample, folds, zip, batch, dedup.

Position is identity for these operations, so each begins with ``row_index`` over a natural key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.ordered import positions, running_sums


def row_index(df: DataFrame, keys: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Positions 0, 1, ... in the order of ``keys``, nulls first; no task sees all rows, whatever their kind and number."""
    return positions(df, [F.col(k).asc_nulls_first() for k in keys], name)


def partition_strided(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    """Part i holds rows i, i+n, ...; position counts within the part."""
    return df.withColumn("part", F.pmod(index, F.lit(n)).cast("int")).withColumn("position", F.floor(F.col(index) / n).cast("long"))


def partition_even(df: DataFrame, n: int, total: int, drop_last: bool = False, index: str = "row_idx") -> DataFrame:
    """Strided parts of one size: padded by starting over, or trimmed."""
    each = -(-(total - n) // n) if drop_last and total % n else -(-total // n)
    if drop_last:
        return partition_strided(df.where(F.col(index) < each * n), n, index)
    again = [df] + [df.where(F.col(index) < min(total, each * n - k * total)).withColumn(index, F.col(index) + k * total) for k in range(1, -(-each * n // total))]
    out = again[0]
    for a in again[1:]:
        out = out.unionByName(a)
    return partition_strided(out, n, index)


def ratio_bounds(ratios: Sequence[float], n: int) -> list[int]:
    """Ends of the parts: each part has floor(ratio share of n + 0.5) rows while rows last."""
    ends, at = [], 0
    for r in ratios:
        at = min(n, at + int(r / sum(ratios) * n + 0.5))
        ends.append(at)
    return ends


def partition_ratios(df: DataFrame, ratios: Sequence[float], total: int, index: str = "row_idx") -> DataFrame:
    """Consecutive parts in proportion to ratios; rows that rounding leaves over are in none."""
    ends = ratio_bounds(ratios, total)
    part = F.lit(None).cast("int")
    for i, e in reversed(list(enumerate(ends))):
        part = F.when(F.col(index) < e, i).otherwise(part)
    return df.withColumn("part", part).where("part is not null")


def partition_stratified(df: DataFrame, by: str, n: int, index: str = "row_idx") -> DataFrame:
    """Strided parts within each class, so that every part has the classes' proportions."""
    ranked = running_sums(df, [by], [F.col(index)], {"__place": F.lit(1)})
    return ranked.withColumn("part", F.pmod(F.col("__place") - 1, F.lit(n)).cast("int")).drop("__place")


def resample(df: DataFrame, factor: float, total: int, index: str = "row_idx") -> DataFrame:
    """The rows floor(factor) times, then the leading fraction of them; copy counts the repeats."""
    whole, extra = int(factor), int(total * (factor - int(factor)) + 0.5)
    copies = F.when(F.col(index) < extra, whole + 1).otherwise(whole)
    return df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))


def cross_validation(df: DataFrame, folds: int, index: str = "row_idx") -> DataFrame:
    """Fold of each row, dealt in turn."""
    return df.withColumn("fold", F.pmod(index, F.lit(folds)).cast("int"))


def zip_rows(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Rows of two tables side by side by position, as many as the shorter has."""
    return row_index(left, left_keys).join(row_index(right, right_keys), "row_idx")


def batches(df: DataFrame, size: int, drop_last: bool = False, index: str = "row_idx") -> DataFrame:
    """One row for each batch of ``size`` consecutive rows, columns stacked in order."""
    cols = [c for c in df.columns if c != index]
    rows = df.withColumn("batch", F.floor(F.col(index) / size).cast("long")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(index, *cols))).alias("r"))
    out = rows.select("batch", F.size("r").alias("n"), *[F.col(f"r.{c}").alias(c) for c in cols])
    return out.where(F.col("n") == size) if drop_last else out


def dedup_by_hash(df: DataFrame, columns: Sequence[str], index: str) -> DataFrame:
    """One row for each distinct content, with the first and last position and how often it stands."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    key = F.sha2(F.concat(*[part(c) for c in columns]), 256)  # lengths keep the columns apart
    return df.groupBy(key.alias("key")).agg(F.min(index).alias("first_idx"), F.max(index).alias("last_idx"), F.count("*").alias("n"))


def weighted_draws(df: DataFrame, weight: str, draws: Sequence[float], key: str, width: int) -> DataFrame:
    """Rows drawn with replacement at fixed uniform numbers, by the cumulative weights in the order of a whole-number key; negative weights are shifted by the least.

    Weights are summed by stretches of ``width`` keys; running sums of these find each draw's stretch,
    and only the stretches found are summed row by row.
    """
    least = df.agg(F.min(weight)).first()[0]
    rows = df.withColumn("__w", F.col(weight) - (least if least is not None and least < 0 else 0)).withColumn("__stretch", F.floor(F.col(key) / width))
    sums = running_sums(rows.groupBy("__stretch").agg(F.sum("__w").alias("__sum")), [], [F.col("__stretch")], {"__hi": F.col("__sum")})
    sums = sums.withColumn("__total", F.lit(rows.agg(F.sum("__w")).first()[0]))
    wanted = F.array(*[F.struct(F.lit(i).alias("draw"), F.lit(float(u)).alias("u")) for i, u in enumerate(draws)])
    inside = lambda lo, hi: F.filter("__draws", lambda x: (x["u"] * F.col("__total") >= lo) & (x["u"] * F.col("__total") < hi))
    sums = sums.withColumn("__draws", wanted).withColumn("__draws", inside(F.col("__hi") - F.col("__sum"), F.col("__hi"))).where(F.size("__draws") > 0)
    sums = sums.select("__stretch", (F.col("__hi") - F.col("__sum")).alias("__before"), "__total", "__draws")  # a row for each draw at most
    hit = rows.join(F.broadcast(sums), "__stretch")
    hit = hit.withColumn("__up", F.col("__before") + F.sum("__w").over(Window.partitionBy("__stretch").orderBy(key)))
    return hit.withColumn("d", F.explode(inside(F.col("__up") - F.col("__w"), F.col("__up")))).select("d.draw", *df.columns)


def hash_shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A repeatable shuffle: order by a hash of seed and key."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def shuffle_buffer(df: DataFrame, by: Sequence[str], order: str, size: int, seed: int = 0) -> DataFrame:
    """A shuffle by a buffer of ``size`` rows, repeatable: within its group each row may move at most so many places back, by a draw from its key; ``place`` numbers the rows as they leave the buffer, from 1. A group of any size is spread over ranges."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    rows = running_sums(df, by, [F.col(order)], {"__in": F.lit(1)}).withColumn("__leaves", F.col("__in") + draw * size)
    return running_sums(rows, by, [F.col("__leaves"), F.col(order)], {"place": F.lit(1)}).select(*df.columns, F.col("place").cast("int").alias("place"))
