"""Queries of ensembles, folds, names, dataset summaries and tensor kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.functions import tensors as X
from stratalens.functions.nd import Nd
from stratalens.operators import datasets as D
from stratalens.plans.registry import query
from stratalens.session import read_table as t
from stratalens.sources import sinks


def r6(c):
    return F.round(c, 6)


@query("with v as (select l_partkey, l_returnflag, count(*) c from lineitem group by 1, 2), m as (select l_partkey, arg_min(l_returnflag, (-c, l_returnflag)) as mode from v group by 1), s as (select l_partkey, avg(l_quantity) a, stddev_samp(l_quantity) d from lineitem group by 1) select l_partkey, mode, round(a, 5) as mean, round(d, 5) as std, round(d / a, 5) as vvc from m join s using (l_partkey)")
def test_time_augmentation(s, d):
    x = t(s, d, "lineitem")
    v = x.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("c"), F.sum("l_quantity").alias("q"))
    mode = v.groupBy("l_partkey").agg(F.min_by("l_returnflag", F.struct((-F.col("c")).alias("a"), "l_returnflag")).alias("mode"))
    m = x.groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"), F.stddev_samp("l_quantity").alias("sd"))
    return mode.join(m, "l_partkey").select("l_partkey", "mode", F.round("a", 5).alias("mean"), F.round("sd", 5).alias("std"), F.round(F.col("sd") / F.col("a"), 5).alias("vvc"))


@query("""with c as (select l_orderkey, case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end as kind, count(*) n from lineitem group by 1, 2), r as (select *, sum(n) over (partition by l_orderkey) total, row_number() over (partition by l_orderkey order by n desc, kind) k, count(*) over (partition by l_orderkey) kinds, first(kind) over (partition by l_orderkey order by n desc, kind) top from c)
select l_orderkey, kind, round(n / (total + 1e-6), 6) as prob from r where k = case when top = 0 and kinds > 1 then 2 else 1 end""")
def instance_type(s, d):
    kind = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    c = t(s, d, "lineitem").groupBy("l_orderkey", kind.alias("kind")).agg(F.count("*").alias("n"))
    g = c.groupBy("l_orderkey").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))).alias("r"))  # at most three kinds
    best = F.when((F.col("r")[0]["kind"] == 0) & (F.size("r") > 1), F.col("r")[1]).otherwise(F.col("r")[0])
    return g.withColumn("b", best).select("l_orderkey", F.col("b.kind").alias("kind"), r6(-F.col("b.m") / (F.col("total") + 1e-6)).alias("prob"))


@query("select doc_id from (select doc_id, (row_number() over (order by doc_id) - 1) % 5 as fold from documents) where fold in (0, 1, 3, 4)")
def select_folds(s, d):
    x = D.cross_validation(D.row_index(t(s, d, "documents").select("doc_id"), ["doc_id"]), 5)
    return x.where(F.col("fold").isin(0, 1, 3, 4)).select("doc_id")


@query("with c as (select l_orderkey, sum(l_quantity) s, sum(l_quantity * l_quantity) q, count(*) n, min(l_quantity) lo, max(l_quantity) hi from lineitem group by 1) select round(sum(s) / sum(n), 6) as mean, round(sqrt(sum(q) / sum(n) - pow(sum(s) / sum(n), 2)), 6) as std, min(lo) as min, max(hi) as max, cast(sum(n) as bigint) as cells from c")
def dataset_summary(s, d):
    c = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("q"), F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    m = F.sum("s") / F.sum("n")
    return c.agg(r6(m).alias("mean"), r6(F.sqrt(F.sum("q") / F.sum("n") - m * m)).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("n").alias("cells"))


@query("select l_orderkey, count(*) as n, round(avg(l_extendedprice), 7) as mean, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem where l_returnflag <> 'N' group by 1")
def foreground_stats(s, d):
    x = t(s, d, "lineitem").where("l_returnflag <> 'N'")
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 7).alias("mean"), F.min("l_extendedprice").alias("min"), F.max("l_extendedprice").alias("max"))


@query("select doc_id, source || '_' || doc_id || '/' || source || '_' || doc_id || '_seg.txt' as path from documents")
def output_names(s, d):
    name = F.concat(F.lit("in/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t(s, d, "documents").select("doc_id", sinks.file_name(name, "seg").alias("path"))


@query("select n_name, r_name, cast(levenshtein(n_name, r_name) as int) as distance from nation join region on n_regionkey = r_regionkey")
def name_distance(s, d):
    x = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("n_name", "r_name", F.levenshtein("n_name", "r_name").alias("distance"))


@query("with x as (select user_id, event_id, row_number() over (partition by user_id order by event_id) + cast(('0x' || substr(md5(concat('3:', event_id)), 1, 8)) as bigint) / 4294967296.0::double * 16 as leaves from events) select user_id, event_id, cast(row_number() over (partition by user_id order by leaves, event_id) as int) as place from x")
def shuffle_buffer(s, d):
    return D.shuffle_buffer(t(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 16, 3).select("user_id", "event_id", "place")


def _images(s, d):
    """Embeddings as 8 x 8 arrays."""
    return t(s, d, "embeddings").select("vec_id", F.array(F.lit(8), F.lit(8)).alias("shape"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def _nine(column: str, f: str) -> str:
    return f"select vec_id, {column} as cell, round({f}, 5) as value from g group by 1, 2"


_GRID = "with e as (select vec_id, cast(i as int) as i, cast(embedding[i + 1] as double) as x from embeddings, unnest(generate_series(0, 63)) as u(i)), k as (select unnest(generate_series(-1, 1)) as a), g as (select e.vec_id, cast((e.i // 8 - p.a) * 8 + (e.i % 8 - q.a) as int) as cell, e.x from e, k p, k q where e.i // 8 - p.a between 0 and 7 and e.i % 8 - q.a between 0 and 7) "


def _cells(df):
    return df.select("vec_id", F.posexplode("data").alias("cell", "value")).withColumn("value", F.round("value", 5))


@query(_GRID + _nine("cell", "sum(x) / 9"))
def tensor_mean_filter(s, d):
    return _cells(_images(s, d).withColumn("data", Nd(F.col("data"), (8, 8)).mean_filter().data))


@query("""with recursive e as (select vec_id, cast(i as int) as i, i // 8 as a, i % 8 as b from embeddings, unnest(range(64)) as u(i) where embedding[i + 1] > 0), n as (select x.vec_id, x.i, y.i as j from e x join e y on x.vec_id = y.vec_id and abs(x.a - y.a) + abs(x.b - y.b) = 1),
r(vec_id, i, root) as (select vec_id, i, i from e union select n.vec_id, n.j, r.root from r join n on r.vec_id = n.vec_id and r.i = n.i where r.root < n.j), c as (select vec_id, i, min(root) as root from r group by 1, 2)
select vec_id, cast(dense_rank() over (partition by vec_id order by root) as int) as component, count(*) as n from c group by vec_id, root""")
def tensor_components(s, d):
    """Sizes of the connected components of positive cells."""
    n = X.apply(_images(s, d), [lambda a: X.components(a > 0)], "vec_id")
    c = n.select("vec_id", F.explode("data").alias("component")).where("component > 0")
    return c.groupBy("vec_id", F.col("component").cast("int").alias("component")).agg(F.count("*").alias("n"))


@query("with x as (select vec_id, label, row_number() over (partition by label order by md5(concat('9:', vec_id))) r from embeddings) select vec_id, label from x where r <= 20")
def class_balanced_sample(s, d):
    x = D.hash_shuffle(t(s, d, "embeddings").select("vec_id", "label"), "vec_id", 9)
    return x.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("shuffle_key"))).where("r <= 20").select("vec_id", "label")


@query("select vec_id, " + " + ".join(f"cast(embedding[{i + 1}] > 0 as int) * {1 << i}" for i in range(8)) + " as bits from embeddings")
def bit_codes(s, d):
    e = F.col("embedding")
    return t(s, d, "embeddings").select("vec_id", reduce(lambda a, b: a + b, [(e[i] > 0).cast("int") * (1 << i) for i in range(8)]).alias("bits"))
