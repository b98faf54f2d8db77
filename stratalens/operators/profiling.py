"""Dataset profiling: statistics by case, their summaries, labels and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.ordered import percentiles

PERCENTS = {"percentile_00_5": 0.005, "percentile_10_0": 0.1, "percentile_90_0": 0.9, "percentile_99_5": 0.995}


def case_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """max, mean, median (the lower middle value), min, population deviation and percentiles of each case."""
    v = F.col(value)
    p = F.percentile(v, F.array(*[F.lit(x) for x in PERCENTS.values()]))
    out = df.groupBy(*by).agg(F.max(v).alias("max"), F.avg(v).alias("mean"), F.expr(f"percentile_disc(0.5) within group (order by `{value}`)").alias("median"), F.min(v).alias("min"), F.stddev_pop(v).alias("stdev"), p.alias("p"))
    return out.select(*by, "max", "mean", "median", "min", "stdev", *[F.col("p")[i].alias(k) for i, k in enumerate(PERCENTS)])


def summary_stats(cases: DataFrame) -> DataFrame:
    """Over cases: greatest max, least min, and means of the other statistics (the median and deviation too)."""
    means = [F.avg(c).alias(c) for c in ("mean", "median", "stdev", *PERCENTS)]
    return cases.agg(F.max("max").alias("max"), F.min("min").alias("min"), *means)


def intensity_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Statistics that skip NaN and NULL."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def label_stats(df: DataFrame, label: str, value: str) -> DataFrame:
    """Statistics of each label and its share of all cells."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("stdev"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def every_nth(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first, (n+1)-th, ... row of each group."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("__i") % n == 0).drop("__i")


def metrics_report(df: DataFrame, sample: str, cls: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(raw rows with each sample's mean over classes, summary by class and of those means)."""
    per = df.groupBy(sample, cls).agg(F.avg(value).alias("value"))
    mean = per.groupBy(sample).agg(F.avg("value").alias("value")).select(sample, F.lit("mean").alias(cls), "value")
    raw = per.select(sample, F.col(cls).cast("string").alias(cls), "value").unionByName(mean)
    stats = raw.groupBy(cls).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    summary = stats.join(percentiles(raw, "value", [cls], [50, 90]), cls).select(cls, "mean", F.col("p")[0].alias("median"), "max", F.col("p")[1].alias("p90"), "std", "n")
    return raw, summary


def label_stats_summary(cases: DataFrame, label: str) -> DataFrame:
    """Over cases (case, label, n, mean, min, max, stdev): of each label the cells, greatest max, least min and the means of the others."""
    return cases.groupBy(label).agg(F.count("*").alias("cases"), F.sum("n").alias("cells"), F.max("max").alias("max"), F.min("min").alias("min"), F.avg("mean").alias("mean"), F.avg("stdev").alias("stdev"))


def label_stats_by_case(df: DataFrame, case: str, label: str, value: str) -> DataFrame:
    """Statistics of the values of each label of each case, and its share of the case."""
    per = df.groupBy(case, label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("stdev"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(case)))


def component_shapes(cells: DataFrame, case: str, label: str, component: str, at: list[str]) -> DataFrame:
    """Of each label of each case the number of its components and their shapes (extent on each axis, larger first by cells)."""
    each = cells.groupBy(case, label, component).agg(F.count("*").alias("cells"), F.array(*[(F.max(a) - F.min(a) + 1).cast("int") for a in at]).alias("shape"))
    return each.groupBy(case, label).agg(F.count("*").alias("components"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cells")).alias("c"), component, "shape"))), lambda s: s["shape"]).alias("shapes"))


def filename_stats(df: DataFrame, column: str, known: DataFrame | None = None, path: str = "path") -> DataFrame:
    """The base name and suffix of each file of a data list, and whether it is among known paths."""
    out = df.withColumn("name", F.regexp_extract(column, r"([^/]*)$", 1)).withColumn("suffix", F.regexp_extract(column, r"((?:\.nii)?\.[^./]*)$", 1))
    if known is None:
        return out
    there = known.select(F.col(path).alias(column)).distinct().withColumn("exists", F.lit(True))
    return out.join(there, column, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def read_folds(items: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(training, validation) of a data list whose records name their fold; records without one train."""
    is_fold = F.coalesce(F.col(column) == fold, F.lit(False))
    return items.where(~is_fold), items.where(is_fold)


def missing_from_report(df: DataFrame, declared: dict[str, object], prefix: str = "") -> list[str]:
    """Dotted names that a declared report format has and a (nested) schema lacks."""
    have, out = {f.name: f.dataType for f in df.schema}, []

    def walk(want, fields, at):
        for name, below in want.items():
            if name not in fields:
                out.append(f"{at}{name}")
            elif isinstance(below, dict) and below:
                kind = getattr(fields[name], "elementType", fields[name])
                walk(below, {f.name: f.dataType for f in getattr(kind, "fields", [])}, f"{at}{name}.")

    walk(declared, have, prefix)
    return out
