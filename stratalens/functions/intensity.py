"""Intensity functions of a column, and of a column with statistics of its group.

Groups may be few and huge, so their statistics are aggregated (combining before the shuffle) and
joined back, which broadcasts them when they are small; a window would sort each group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.ordered import percentiles


def with_group_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """The rows with aggregates of their group; null keys are a group."""
    got = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    got = got.select(*[F.col(k).alias(f"__k_{k}") for k in by], *stats)
    return df.join(got, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])).drop(*[f"__k_{k}" for k in by])


def threshold_intensity(c: Column, at: float, above: bool = True, fill: float = 0.0) -> Column:
    """Values strictly above (or below) a threshold stay."""
    return F.when(c > at if above else c < at, c).otherwise(F.lit(fill))


def rescale(c: Column, lo: Column, hi: Column, new_lo: float = 0.0, new_hi: float = 1.0) -> Column:
    """From [lo, hi] to a new range; a constant group gives value times the new minimum."""
    return F.when(hi == lo, c * new_lo).otherwise((c - lo) / (F.nullif(hi - lo, F.lit(0.0))) * (new_hi - new_lo) + new_lo)


def scale_minmax(df: DataFrame, value: str, by: list[str], name: str, new_lo: float = 0.0, new_hi: float = 1.0, small_groups: bool = False) -> DataFrame:
    """``small_groups``: groups are many and small (records), so one shuffle with a window is cheaper than a join."""
    if small_groups:
        w = Window.partitionBy(*by)
        return df.withColumn(name, rescale(F.col(value), F.min(value).over(w), F.max(value).over(w), new_lo, new_hi))
    out = with_group_stats(df, by, __lo=F.min(value), __hi=F.max(value))
    return out.withColumn(name, rescale(F.col(value), F.col("__lo"), F.col("__hi"), new_lo, new_hi)).drop("__lo", "__hi")


def scale_range(c: Column, a_min: float, a_max: float, b_min: float | None, b_max: float | None, clip: bool = False) -> Column:
    """Linear map of [a_min, a_max] to [b_min, b_max], clipped to it if asked."""
    x = (c - a_min) if a_max == a_min else (c - a_min) / (a_max - a_min)
    if a_max == a_min:
        return x if b_min is None else x + b_min
    if b_min is not None and b_max is not None:
        x = x * (b_max - b_min) + b_min
    return F.least(F.greatest(x, F.lit(b_min)), F.lit(b_max)) if clip else x


def group_percentiles(df: DataFrame, value: str, by: list[str], percents: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation of groups that may be few and huge."""
    return percentiles(df, value, by, percents)


def scale_range_percentiles(df: DataFrame, value: str, by: list[str], lower: float, upper: float, b_min: float, b_max: float, name: str, clip: bool = False) -> DataFrame:
    p = group_percentiles(df, value, by, [lower, upper])
    out = df.join(p, by)
    lo, hi = F.col("p")[0], F.col("p")[1]
    x = F.when(hi == lo, F.col(value) - lo + b_min).otherwise((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * (b_max - b_min) + b_min)
    if clip:
        x = F.least(F.greatest(x, F.lit(b_min)), F.lit(b_max))
    return out.withColumn(name, x).drop("p")


def soft_clip(c: Column, lo: Column | None, hi: Column | None, sharpness: float = 10.0) -> Column:
    """Smooth clipping: near the bounds values bend instead of breaking off."""
    out = c
    if lo is not None:
        out = out + F.log(F.lit(1.0) + F.exp(-sharpness * (c - lo))) / sharpness
    if hi is not None:
        out = out - F.log(F.lit(1.0) + F.exp(sharpness * (c - hi))) / sharpness
    return out


def normalize_all(df: DataFrame, values: dict[str, tuple[str, bool]], by: list[str]) -> DataFrame:
    """``normalize`` of several columns, {value: (name, nonzero)}, with one pass for all statistics."""
    kept = {v: F.when(F.col(v) != 0, F.col(v)) if nonzero else F.col(v) for v, (_, nonzero) in values.items()}
    stats = {f"__{k}_{i}": f(x) for i, x in enumerate(kept.values()) for k, f in (("mean", F.avg), ("dev", F.stddev_pop))}
    out = with_group_stats(df, by, **stats)
    for i, (value, (name, nonzero)) in enumerate(values.items()):
        dev = F.col(f"__dev_{i}")
        z = (F.col(value) - F.col(f"__mean_{i}")) / F.when(dev == 0, F.lit(1.0)).otherwise(dev)
        out = out.withColumn(name, F.when(F.col(value) == 0, F.lit(0.0)).otherwise(z) if nonzero else z)
    return out.drop(*stats)


def normalize(df: DataFrame, value: str, by: list[str], name: str, nonzero: bool = False) -> DataFrame:
    """(x - mean) / population deviation of the group, a zero deviation counting as 1; with ``nonzero`` zeros stay and don't count."""
    return normalize_all(df, {value: (name, nonzero)}, by)


def std_shift(df: DataFrame, value: str, by: list[str], factor: float, name: str) -> DataFrame:
    return with_group_stats(df, by, __dev=F.stddev_pop(value)).withColumn(name, F.col(value) + factor * F.col("__dev")).drop("__dev")


def fixed_mean_scale(df: DataFrame, value: str, by: list[str], factor: float, name: str) -> DataFrame:
    """(1 + factor) times the values about their mean, so that the mean stays."""
    out = with_group_stats(df, by, __mean=F.avg(value))
    return out.withColumn(name, (F.col(value) - F.col("__mean")) * (1 + factor) + F.col("__mean")).drop("__mean")


def adjust_contrast(df: DataFrame, value: str, by: list[str], gamma: float, name: str) -> DataFrame:
    """((x - min) / (range + 1e-7)) ^ gamma x range + min."""
    out = with_group_stats(df, by, __lo=F.min(value), __hi=F.max(value))
    lo, span = F.col("__lo"), F.col("__hi") - F.col("__lo")
    return out.withColumn(name, F.pow((F.col(value) - lo) / (span + 1e-7), F.lit(gamma)) * span + lo).drop("__lo", "__hi")


def mask_intensity(c: Column, mask: Column) -> Column:
    return F.when(mask, c).otherwise(F.lit(0.0))


def bin_of(c: Column, lo: float, hi: float, n: int) -> Column:
    """Histogram bin from 0; the last bin is closed on the right, values outside have none."""
    k = F.least(F.floor((c - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int")
    return F.when((c >= lo) & (c <= hi), k)


def histogram(df: DataFrame, value: str, by: list[str], lo: float, hi: float, n: int) -> DataFrame:
    return df.withColumn("bin", bin_of(F.col(value), lo, hi, n)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def equalize_histogram(df: DataFrame, value: str, n: int, name: str, new_lo: float = 0.0, new_hi: float = 255.0) -> DataFrame:
    """Values by their cumulated histogram: ``n`` bins between the least and greatest value, running counts scaled to a new range, and straight lines between the bins' middles.

    Values outside the first and last middle get the first or last level. The table of bins is n rows;
    null values stay null and don't count.
    """
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    width = (hi - lo) / n
    count = {r["bin"]: r["n"] for r in histogram(df, value, [], lo, hi, n).collect()}  # n rows
    run, total = [], 0
    for k in range(n):
        total += count.get(k, 0)
        run.append(float(total))
    span = run[-1] - run[0]
    level = [(r - run[0]) / span * (new_hi - new_lo) + new_lo if span else r * new_lo for r in run]
    table = F.array(*map(F.lit, level))
    at = (F.col(value) - lo) / width - 0.5  # place among the middles
    k = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(n - 2)).cast("int")
    share = F.least(F.greatest(at - k, F.lit(0.0)), F.lit(1.0))
    a, b = F.element_at(table, k + 1), F.element_at(table, k + 2)
    return df.withColumn(name, a + (b - a) * share if n > 1 else F.when(F.col(value).isNotNull(), F.lit(level[0])))
