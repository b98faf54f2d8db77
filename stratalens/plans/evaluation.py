"""Evaluation of records as one plan: predictions, post-processing, metrics by record, their summary, logs and stopping rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Evaluator:
    """What to work out for each record: ``prepare`` columns from the input, named ``predict`` functions (of the record's columns), ``post`` steps on a prediction, and metrics of prediction and record.

    Several predictions are an ensemble; ``combine`` (mean by default) joins their values.
    """

    key: str
    predict: Mapping[str, Callable[[], Column]]
    metrics: Mapping[str, Callable[[Column], Column]]
    prepare: Mapping[str, Column] = field(default_factory=dict)
    post: Sequence[Callable[[Column], Column]] = ()
    combine: Callable[[Sequence[Column]], Column] | None = None

    def predictions(self, df: DataFrame) -> DataFrame:
        x = df.withColumns(dict(self.prepare)) if self.prepare else df
        x = x.withColumns({f"pred_{n}": f() for n, f in self.predict.items()})
        each = [F.col(f"pred_{n}") for n in self.predict]
        joined = self.combine(each) if self.combine else reduce(Column.__add__, each) / len(each)
        for step in self.post:
            joined = step(joined)
        return x.withColumn("pred", joined)

    def details(self, df: DataFrame) -> DataFrame:
        """The key and every metric of each record; a value that can't be worked out is NULL."""
        clean = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
        return self.predictions(df).select(self.key, *[clean(f(F.col("pred"))).alias(n) for n, f in self.metrics.items()])

    def summary(self, df: DataFrame) -> DataFrame:
        """metric, mean, min, max, n over records; NULLs don't count."""
        d = self.details(df)
        rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in self.metrics])
        long = d.select(F.explode(rows).alias("r")).select("r.metric", "r.value")
        return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def log_metrics(summary: DataFrame, epoch: int, path: str) -> None:
    """The summary of an epoch added to a log table."""
    summary.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)


def best_epoch(log: DataFrame, metric: str, larger: bool = True) -> DataFrame:
    """The epoch of a log whose metric is best, the earliest of equal ones."""
    value = F.col("mean") if larger else -F.col("mean")
    return log.where(F.col("metric") == metric).agg(F.max_by("epoch", F.struct(value, -F.col("epoch"))).alias("epoch"), (F.max("mean") if larger else F.min("mean")).alias("mean"))


def should_stop(log: DataFrame, metric: str, patience: int, larger: bool = True, least_gain: float = 0.0) -> bool:
    """Whether the last ``patience`` epochs of a log brought no value better than the best before by more than the least gain."""
    rows = [r["mean"] for r in log.where(F.col("metric") == metric).orderBy("epoch").select("mean").collect()]  # one row for each epoch
    best, waited = None, 0
    for x in rows:
        x = x if larger else -x
        if best is None or x > best + least_gain:
            best, waited = x, 0
        else:
            waited += 1
    return waited >= patience
