"""Streaming: counted chunks, rotating caches, completion counters and event-time windows.

Each function works on a streaming or a batch DataFrame alike, or says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stratalens.storage import new_path


def chunk_counts(df: DataFrame, index: str, size: int, value: str) -> DataFrame:
    """Rows and sums of tumbling chunks by count of a running index."""
    return df.groupBy(F.floor(F.col(index) / size).cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def smart_cache(df: DataFrame, index: str, total: int, cached: int, replaced: int, epoch: int) -> DataFrame:
    """The rows that a rotating cache holds in an epoch: a window that moves on by the rows replaced."""
    start = epoch * replaced % total
    return df.where(F.pmod(F.col(index) - start, F.lit(total)) < cached)


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """With a watermark if rows may be late by so much; event times without a zone are read in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else df


def _start(df: DataFrame, ts: str) -> Column:
    return F.col("w.start").cast(dict(df.dtypes)[ts]).alias("start")


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    x = _marked(df, ts, late)
    w = F.window(ts, width)
    return x.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(_start(df, ts), *by, "n", "total")


def sliding(df: DataFrame, ts: str, width: str, step: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    x = _marked(df, ts, late)
    return x.groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(_start(df, ts), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    x = _marked(df, ts, late)
    return x.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(_start(df, ts), *by, "n")


def completion(df: DataFrame, key: str, part: str, expected: str, ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counter of a key's different parts as a stream: a row with the count seen and whether all have come.

    State ends: parts are forgotten as soon as all have come, and the key itself when the watermark, ``late``
    behind the latest event time (time of arrival without ``ts``), passes its latest event. Until then a part
    that comes again changes nothing.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    at = ts or "__arrived"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts, seen, want, latest = state.get if state.exists else ([], 0, 0, 0)
        have, done = set(parts), seen > 0 and seen >= want
        for b in batches:
            want = max(want, int(b[expected].max()))
            have.update(b[part].dropna().astype(int).tolist())
            latest = max(latest, int(b[at].max().timestamp() * 1000))
        seen = seen if done else len(have)
        done = seen >= want
        state.update(([] if done else sorted(have), seen, want, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "complete": [done]})

    rows = _marked(df if ts else df.withColumn(at, F.current_timestamp()), at, late)
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} long, seen long, complete boolean", "parts array<long>, seen long, want long, latest long", "update", GroupStateTimeout.EventTimeTimeout)


def with_closing(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """A stream that also takes rows of event time alone from a folder, so that ``close`` can end it: what waits for the watermark then comes out."""
    empty = [F.col(ts) if c == ts else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes]
    ends = stream.sparkSession.readStream.schema(f"{ts} {dict(stream.dtypes)[ts]}").parquet(folder)
    return stream.unionByName(ends.select(*empty))


def close(spark: SparkSession, ts: str, kind: str, folder: str, at: str = "9999-01-01") -> None:
    """Write the row that ends a stream: an event later than any other."""
    spark.range(1).select(F.lit(at).cast(kind).alias(ts)).write.mode("append").parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Run a stream over what is there now, each micro-batch through a function of (rows, number); with a checkpoint folder a later run goes on where this one ended."""
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.foreachBatch(each).start().awaitTermination()


def run_partial(stream: DataFrame, name: str, keys: Sequence[str], sums: Sequence[str], aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sums by key over all that a stream has brought, without state: each micro-batch is aggregated by itself and written, and the parts are added up where the table is read."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    kinds: list = []

    def write(batch: DataFrame, number: int) -> None:
        part = aggregate(batch)
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kinds.append(part.schema)

    run_available(stream, write)
    if not kinds:
        return aggregate(spark.createDataFrame([], stream.schema))
    return spark.read.schema(kinds[0]).parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def run_to_table(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = (), closing: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there now and give its result as a Parquet table in the shared folder; nothing of it goes to the driver.

    Each batch is a folder of its own, which a repeated batch overwrites. ``append``: all rows. ``update``:
    of each key the row of the latest batch. ``complete``: the last batch. With ``closing`` the stream runs on
    from where it stopped once more after that function was called, as ``close`` asks for.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    at = new_path(spark, "progress") if closing else None
    run_available(stream, write, mode, at)
    if closing:
        closing()
        run_available(stream, write, mode, at)
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={done[-1]}")
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(path)
    if mode == "append":
        return out.drop("batch")
    latest = out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("x"))
    return latest.select(*[F.col(f"x.{c}").alias(c) for c in stream.columns])
