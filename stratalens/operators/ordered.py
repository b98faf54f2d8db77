"""Operations in a global order without a task that sees all rows: positions, running sums, exact percentiles.

Rows are dealt by ranges of the order and written with the number of their range, so that both the
sums of ranges (one row each) and the rows themselves see the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.storage import written


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Positions 0, 1, ... of the rows in an order; rows that the order doesn't tell apart come in any."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("__id", F.monotonically_increasing_id()), "ordered")  # range << 33 | place in it
    rows = rows.withColumn("__range", F.shiftright("__id", 33)).withColumn("__id", F.col("__id").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    return rows.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__id")).drop("__range", "__id", "__before")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with sums up to and with themselves, within their group (null is a group) in an order; a group of any size is spread over ranges.

    The order tells the rows of a group apart.
    """
    groups = [F.col(c) for c in by]
    rows = df.withColumns({f"__{n}": c for n, c in sums.items()})
    rows = written(rows.repartitionByRange(*groups, *order).withColumn("__range", F.spark_partition_id()), "ranges") if by or order else rows
    per = rows.groupBy(*by, "__range").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    up = Window.partitionBy(*by).orderBy("__range")  # a row for each range and group in it
    per = per.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__range").alias("__r"), *[(F.sum(f"__t_{n}").over(up) - F.col(f"__t_{n}")).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"__{n}": F.sum(f"__{n}").over(inside) for n in sums})
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out = rows.join(per, same).withColumns({n: F.col(f"__b_{n}") + F.col(f"__{n}") for n in sums})
    return out.select(*df.columns, *sums)


def percentiles(df: DataFrame, value: str, by: Sequence[str], percents: Sequence[float]) -> DataFrame:
    """``by`` and p: exact percentiles (0 to 100) of each group with linear interpolation, as an array; null values don't count.

    Values with their counts combine before they move; running counts tell which two values stand at a
    percentile's rank, and only these are kept.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    counts = running_sums(counts, by, [F.col(value)], {"__upto": F.col("__n")})
    total = counts.groupBy(*by).agg(F.max("__upto").alias("__total")).select(*[F.col(c).alias(f"__g_{c}") for c in by], "__total")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    ranked = counts.join(total, same) if by else counts.withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one")  # one row
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("__total") - 1) * F.lit(p / 100.0)).alias("at")) for i, p in enumerate(percents)])
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
    here = F.filter(wanted, lambda w: ((F.floor(w["at"]) >= first) & (F.floor(w["at"]) <= last)) | ((F.ceil(w["at"]) >= first) & (F.ceil(w["at"]) <= last)))
    hit = ranked.withColumn("w", F.explode(here))
    share = F.col("w.at") - F.floor("w.at")
    v = F.col(value).cast("double")
    at_low = (F.floor("w.at") >= first) & (F.floor("w.at") <= last)
    at_high = (F.ceil("w.at") >= first) & (F.ceil("w.at") <= last)
    # Both ranks on one value: the value itself, free of rounding.
    part = F.when(at_low & at_high, v).when(at_low, v * (1 - share)).otherwise(v * share)
    each = hit.groupBy(*by, F.col("w.i").alias("i")).agg(F.sum(part).alias("v"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select(*by, F.col("x.v").alias("p"))
