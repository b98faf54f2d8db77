"""Streaming queries, each run over what the events table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import datasets as D
from stratalens.plans.registry import query
from stratalens.session import read_table as t
from stratalens.storage import new_path
from stratalens.streaming import streams as ST


def _stream(s, d, name="events"):
    """A table as a stream: its folder, or, if it is one file, the folder that holds it with a filter for its name."""
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    r = s.readStream.schema(t(s, d, name).schema)
    return r.parquet(f"{d}/{name}.parquet") if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("select cast(event_id // 100 as bigint) as chunk, count(*) as n, round(sum(value), 6) as total from events group by 1")
def stream_chunk_counts(s, d):
    """No state: the chunks of each micro-batch are added up where the table is read."""
    x = ST.run_partial(_stream(s, d), "chunks", ["chunk"], ["n", "total"], lambda b: ST.chunk_counts(b, "event_id", 100, "value"))
    return x.withColumn("total", F.round("total", 6))


@query("with x as (select event_id, event_id - min(event_id) over () as i, count(*) over () as n from events) select event_id, cast(i as bigint) as row_idx from x where (i - (3 * (n // 20)) % n + n) % n < n // 4")
def stream_smart_cache(s, d):
    """The rows of a stream that a rotating cache of a quarter of them holds in its fourth epoch; ids number the rows."""
    n, least = t(s, d, "events").agg(F.count("*"), F.min("event_id")).first()
    e = _stream(s, d).select("event_id", (F.col("event_id") - (least or 0)).alias("row_idx"))
    return ST.run_to_table(ST.smart_cache(e, "row_idx", n, n // 4, n // 20, 3), "cache")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(s, d):
    return ST.run_to_table(ST.tumbling(_stream(s, d), "ts", "1 hour", ["event_type"], "value", late="1 day"), "tumbling", "update", ["start", "event_type"])


@query("""with w as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start, event_type, value from events)
select start, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2""")
def stream_sliding(s, d):
    return ST.run_to_table(ST.sliding(_stream(s, d), "ts", "1 hour", "30 minutes", ["event_type"], "value", late="1 day"), "sliding", "update", ["start", "event_type"])


@query("""with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '2 hours' then 0 else 1 end as fresh from events), r as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as run from g)
select user_id, min(ts) as start, count(*) as n from r group by user_id, run""")
def stream_session(s, d):
    """Sessions leave the state when the watermark passes them; a closing event brings the last ones out."""
    folder = new_path(s, "closing")
    events = _stream(s, d)
    s.createDataFrame([], events.select("ts").schema).write.parquet(folder)
    x = ST.sessions(ST.with_closing(events, "ts", folder), "ts", "2 hours", ["user_id"], late="1 day")
    out = ST.run_to_table(x, "sessions", closing=lambda: ST.close(s, "ts", dict(events.dtypes)["ts"], folder))
    return out.where("start < timestamp '9998-01-01'").select("user_id", "start", "n")


@query("select event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def stream_running_metric(s, d):
    x = _stream(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return ST.run_to_table(x, "running", "update", ["event_type"])


@query("""with e as (select *, ntile(4) over (order by event_id + cast(('0x' || substr(md5(concat('5:', event_id)), 1, 8)) as bigint) / 4294967296.0::double * 5000, event_id) - 1 as k from events), m as (select k, max(ts) as top from e group by 1), w as (select k, max(top) over (order by k rows between unbounded preceding and 2 preceding) - interval '6 hours' as mark from m)
select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n from e join w using (k) where mark is null or time_bucket(interval '1 hour', ts) + interval '1 hour' > date_trunc('millisecond', mark) group by 1, 2""")
def stream_late_data(s, d):
    """Events arrive in four batches in the order of their ids, but for a delay of up to 5,000 rows; a row whose hour ended six hours before the latest event that the batch before knew of is late and dropped."""
    delay = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32) * 5000
    e = t(s, d, "events").select("event_id", "event_type", "ts", (F.col("event_id") + delay).alias("arrives"))
    e = D.row_index(e, ["arrives", "event_id"]).drop("arrives")
    n = e.count()
    each, extra = n // 4, n % 4  # the first parts are one row longer
    ends = [each * (k + 1) + min(k + 1, extra) for k in range(4)]
    path = new_path(s, "arrivals")
    files = max(1, min(int(s.conf.get("spark.sql.shuffle.partitions")), each))  # rows are dealt in turn, so that each part has just so many files, and they are a batch
    for k in range(4):
        part = e.where((F.col("row_idx") >= (ends[k - 1] if k else 0)) & (F.col("row_idx") < ends[k]))
        part.repartitionById(files, (F.col("row_idx") % files).cast("int")).drop("row_idx").write.parquet(f"{path}/part={k}")
    r = s.readStream.schema("event_id long, event_type string, ts timestamp, part int").option("maxFilesPerTrigger", files).parquet(path)
    x = r.withWatermark("ts", "6 hours").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return ST.run_to_table(x.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "late", "update", ["event_type", "start"])


@query("select conv_id, count(distinct turn) as seen, count(distinct turn) >= max(turn) + 1 as complete from conversations group by 1")
def stream_completion(s, d):
    """Turns of conversations as they arrive: how many have come, and whether all have, kept in state until complete."""
    x = _stream(s, d, "conversations").select("conv_id", "turn", (F.col("turn") + 1).cast("long").alias("expected"))
    return ST.run_to_table(ST.completion(x, "conv_id", "turn", "expected"), "completion", "update", ["conv_id"])
