"""Queries of metrics, rankings, profiling and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.functions import arrays as A
from stratalens.operators import metrics as M
from stratalens.operators import profiling as P
from stratalens.operators.datasets import row_index
from stratalens.operators.ordered import percentiles
from stratalens.plans.registry import query
from stratalens.session import read_table as t
from stratalens.storage import written


def r6(c):
    return F.round(c, 6)


def judged(s, d):
    """Documents with labels: prediction = longer than 1,000 characters, truth = quality."""
    x = t(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(s, d, "labels"), "doc_id")
    return x.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 1000).cast("int").alias("y_pred"), F.col("quality").alias("y"), "toxic")


JUDGED = "with j as (select doc_id, lang, source, cast(n_chars as double) as score, cast(n_chars > 1000 as int) as p, quality as y, toxic from documents join labels using (doc_id)), c as (select {by}, sum(cast(p = 1 and y = 1 as bigint)) tp, sum(cast(p = 1 and y = 0 as bigint)) fp, sum(cast(p = 0 and y = 0 as bigint)) tn, sum(cast(p = 0 and y = 1 as bigint)) fn from j group by {by}) "
BY_LANG, BY_SOURCE = JUDGED.format(by="lang"), JUDGED.format(by="source")


@query(BY_LANG + "select lang, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(tn as bigint) tn, cast(fn as bigint) fn from c")
def confusion_counts(s, d):
    return M.confusion_counts(judged(s, d), ["lang"])


_RATES = {
    "tpr": "tp / nullif(tp + fn, 0)", "tnr": "tn / nullif(fp + tn, 0)", "ppv": "tp / nullif(tp + fp, 0)", "npv": "tn / nullif(tn + fn, 0)", "fnr": "fn / nullif(tp + fn, 0)", "fpr": "fp / nullif(fp + tn, 0)",
    "fdr": "fp / nullif(fp + tp, 0)", "for": "fn / nullif(fn + tn, 0)", "pt": "(sqrt(tp / nullif(tp + fn, 0) * (1 - tn / nullif(fp + tn, 0))) + tn / nullif(fp + tn, 0) - 1) / nullif(tp / nullif(tp + fn, 0) + tn / nullif(fp + tn, 0) - 1, 0)",
    "ts": "tp / nullif(tp + fn + fp, 0)", "acc": "(tp + tn) / nullif(tp + tn + fp + fn, 0)", "ba": "(tp / nullif(tp + fn, 0) + tn / nullif(fp + tn, 0)) / 2", "f1": "2 * tp / nullif(2 * tp + fn + fp, 0)",
    "mcc": "(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)", "fm": "sqrt(tp / nullif(tp + fp, 0) * tp / nullif(tp + fn, 0))", "bm": "tp / nullif(tp + fn, 0) + tn / nullif(fp + tn, 0) - 1", "mk": "tp / nullif(tp + fp, 0) + tn / nullif(tn + fn, 0) - 1",
}


@query(BY_LANG + ", d as (select lang, cast(tp as double) tp, cast(fp as double) fp, cast(tn as double) tn, cast(fn as double) fn from c) select lang, " + ", ".join(f'round({x}, 6) as "{n}"' for n, x in _RATES.items()) + " from d")
def confusion_17(s, d):
    c = M.confusion_counts(judged(s, d), ["lang"])
    return c.select("lang", *[r6(x).alias(n) for n, x in M.confusion_metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).items()])


@query(BY_SOURCE + "select source, round(case when 5 * tp + 4 * fn + fp = 0 then 0 else 5.0 * tp / (5 * tp + 4 * fn + fp) end, 6) as value from c")
def f_beta(s, d):
    c = M.confusion_counts(judged(s, d), ["source"])
    return c.select("source", r6(M.f_beta(F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double"), 2.0)).alias("value"))


@query(BY_SOURCE + "select source, round(case when tp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) end, 6) as dice, round(case when tp + fn > 0 then 1.0 * tp / (tp + fp + fn) end, 6) as iou from c")
def dice_iou(s, d):
    c = M.confusion_counts(judged(s, d), ["source"])
    a = [F.col(x) for x in ("tp", "fp", "fn")]
    return c.select("source", r6(M.dice(*a)).alias("dice"), r6(M.iou(*a)).alias("iou"))


@query("""with j as (select source, lang, cast(n_chars > 1000 as int) p, quality y from documents join labels using (doc_id)), c as (select source, lang, sum(p * y) tp, sum(p * (1 - y)) fp, sum((1 - p) * y) fn from j group by 1, 2), w as (select *, coalesce(1.0 / nullif((tp + fn) * (tp + fn), 0), max(1.0 / nullif((tp + fn) * (tp + fn), 0)) over (partition by source), 0) w from c)
select source, round(case when sum(w * (2 * tp + fp + fn)) > 0 then sum(2 * w * tp) / sum(w * (2 * tp + fp + fn)) when sum(tp + fp) = 0 then 1 else 0 end, 6) as value from w group by 1""")
def generalized_dice(s, d):
    c = M.confusion_counts(judged(s, d), ["source", "lang"])
    return M.generalized_dice(c, "source").select("source", r6("value").alias("value"))


_CELLS = "with f as (select l_orderkey as sample_id, l_returnflag as class_id, case when avg(l_discount) > 0.02 then avg(l_discount) end as value from lineitem group by 1, 2) "


def _cells(s, d):
    x = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("class_id")).agg(F.avg("l_discount").alias("v"))
    return x.select("sample_id", "class_id", F.when(F.col("v") > 0.02, F.col("v")).alias("value"))


@query(_CELLS + """select 'mean' as mode, null as key, round(coalesce(avg(m), 0), 6) as value, count(m) as n from (select avg(value) m from f group by sample_id)
union all select 'sum', null, round(coalesce(sum(value), 0), 6), count(value) from f
union all select 'mean_batch', class_id, round(coalesce(avg(value), 0), 6), count(value) from f group by class_id
union all select 'sum_batch', class_id, round(coalesce(sum(value), 0), 6), count(value) from f group by class_id
union all select 'mean_channel', cast(sample_id as varchar), round(coalesce(avg(value), 0), 6), count(value) from f group by sample_id
union all select 'sum_channel', cast(sample_id as varchar), round(coalesce(sum(value), 0), 6), count(value) from f group by sample_id""")
def reduction_modes(s, d):
    f, out = written(_cells(s, d), "cells"), None
    for mode in M.MODES[1:]:
        key = F.col("class_id") if mode.endswith("batch") else F.col("sample_id").cast("string") if mode.endswith("channel") else F.lit(None).cast("string")
        x = M.reduce_metric(f, mode).select(F.lit(mode).alias("mode"), key.alias("key"), r6("value").alias("value"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("""with e as (select l_orderkey, l_extendedprice / l_quantity as p, p_retailprice * 1.0471975511965976::double as y from lineitem join part on l_partkey = p_partkey), m as (select l_orderkey, avg((p - y) * (p - y)) mse, avg(abs(p - y)) mae from e group by 1)
select l_orderkey, round(mse, 3) as mse, round(mae, 5) as mae, round(sqrt(mse), 5) as rmse, round(case when mse > 0 then 20 * log10(2000) - 10 * log10(mse) end, 6) as psnr from m""")
def regression_metrics(s, d):
    """Unit prices against part prices times a factor with no short decimal form, so that no result lies on a rounding border."""
    x = t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), (F.col("p_retailprice") * 1.0471975511965976).alias("y"))
    m = M.regression(x, "l_orderkey", "p", "y", 2000.0)
    return m.select("l_orderkey", F.round("mse", 3).alias("mse"), F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), r6("psnr").alias("psnr"))


_AUC = "with j as (select cast(n_chars as double) as score, quality as y, lang, toxic from documents join labels using (doc_id)){more}, g as (select {k} score, sum(y) p, count(*) - sum(y) n from j group by all), b as (select *, sum(n) over ({part} order by score) - n as below from g) "
_AUC_VALUE = "sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0)"


@query(_AUC.format(more="", k="", part="") + f"select round({_AUC_VALUE}, 6) as value from b")
def roc_auc(s, d):
    return M.roc_auc(judged(s, d)).select(r6("value").alias("value"))


_PER_LANG = _AUC.format(more="", k="lang,", part="partition by lang") + f", v as (select lang, {_AUC_VALUE} as value, sum(p) as weight from b group by lang) "


@query(_PER_LANG + "select case when count(*) = count(value) then round(avg(value), 6) end as value from v")
def roc_auc_macro(s, d):
    return M.averaged(M.roc_auc(judged(s, d), by=("lang",)), "macro").select(r6("value").alias("value"))


@query(_PER_LANG + "select case when count(*) = count(value) then round(sum(value * weight) / sum(weight), 6) end as value from v")
def roc_auc_weighted(s, d):
    j = judged(s, d)
    per = M.roc_auc(j, by=("lang",)).join(j.groupBy("lang").agg(F.sum("y").alias("weight")), "lang")
    return M.averaged(per, "weighted").select(r6("value").alias("value"))


@query("""with j as (select cast(n_chars as double) as score, quality, toxic from documents join labels using (doc_id)), m as (select score, quality as y from j union all select -score, toxic from j), g as (select score, sum(y) p, count(*) - sum(y) n from m group by 1), b as (select *, sum(n) over (order by score) - n as below from g) select round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) as value from b""")
def roc_auc_micro(s, d):
    j = judged(s, d)
    both = j.select("score", "y").unionByName(j.select((-F.col("score")).alias("score"), F.col("toxic").alias("y")))
    return M.roc_auc(both).select(r6("value").alias("value"))


@query("""with g as (select cast(n_chars as double) as score, sum(quality) p, count(*) c from documents join labels using (doc_id) group by 1), b as (select *, sum(p) over (order by score desc) cp, sum(c) over (order by score desc) cc from g) select round(sum(p * cp / cc) / sum(p), 6) as value from b""")
def average_precision(s, d):
    return M.average_precision(judged(s, d)).select(r6("value").alias("value"))


@query("""with e as (select round(value, 1) as score, cast(event_type = 'purchase' as int) y from events), g as (select score, sum(y) p, count(*) c from e group by 1), b as (select score, sum(p) over (order by score desc) tp, sum(c - p) over (order by score desc) fp, min(score) over () least from g), n as (select sum(cast(event_type = 'purchase' as int)) nt, count(distinct user_id) ni from events)
select score as threshold, round(fp / ni, 6) as fps, round(tp / nt, 6) as sensitivity from b, n where score > least""")
def froc_curve(s, d):
    e = t(s, d, "events").select(F.round("value", 1).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"), "user_id")
    n = e.agg(F.sum("y").alias("t"), F.countDistinct("user_id").alias("i")).first()
    return M.froc_curve(e, n.i, n.t).select("threshold", r6("fps").alias("fps"), r6("sensitivity").alias("sensitivity"))


@query("select event_type, round(sum(value * event_id) / sum(event_id), 6) as value, cast(sum(event_id) as double) as count from events where value is not null group by 1")
def cumulative_average(s, d):
    return M.cumulative_average(t(s, d, "events"), "value", ["event_type"], "event_id").select("event_type", r6("value").alias("value"), "count")


@query("select label, round(var_pop(case when x <= 0 then 0.0005 else x end), 6) as value from (select label, cast(unnest(embedding) as double) as x from embeddings) group by 1")
def variance_metric(s, d):
    x = t(s, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return M.variance_metric(x, ["label"], "x", 0.0005).select("label", r6("value").alias("value"))


_SIDES = "with x as (select label % 2 as side, unnest(generate_series(0, 63)) as dim, cast(unnest(embedding) as double) as x from embeddings), g as (select side, dim, count(*) n, sum(x) s, sum(x * x) ss, var_samp(x) v from x group by 1, 2), p as (select a.dim, a.n n0, a.s s0, a.ss q0, a.v v0, b.n n1, b.s s1, b.ss q1, b.v v1 from g a join g b on a.dim = b.dim and a.side = 0 and b.side = 1) "


def _sides(s, d):
    return t(s, d, "embeddings").select((F.col("label") % 2).alias("side"), "embedding")


@query(_SIDES + "select round(sum(s0 * s0 - q0) / (max(n0) * (max(n0) - 1)) + sum(s1 * s1 - q1) / (max(n1) * (max(n1) - 1)) - 2 * sum(s0 * s1) / (max(n0) * max(n1)), 6) as value from p")
def mmd_linear(s, d):
    return M.mmd_linear(_sides(s, d), "side", "embedding").select(r6("value").alias("value"))


@query(_SIDES + "select round(sum((s0 / n0 - s1 / n1) * (s0 / n0 - s1 / n1) + v0 + v1 - 2 * sqrt(v0 * v1)), 6) as value from p")
def fid_diag(s, d):
    return M.frechet_diagonal(_sides(s, d), "side", "embedding").select(r6("value").alias("value"))


@query()
def fid_full(s, d):
    return M.frechet_full(_sides(s, d), "side", "embedding", 64).select(r6("value").alias("value"))


@query("""with c as (select case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end g, case l_linestatus when 'O' then 0 else 1 end p, count(*) n from lineitem group by 1, 2), ga as (select g, sum(n) a from c group by 1), pa as (select p, sum(n) a from c group by 1), m as (select n / (ga.a + pa.a - n) iou from c join ga using (g) join pa using (p) where g <> 0 and p <> 0 and n / (ga.a + pa.a - n) > 0.1), h as (select count(*) tp, coalesce(sum(iou), 0) s from m), k as (select count(distinct case when g <> 0 then g end) ng, count(distinct case when p <> 0 then p end) np from c)
select tp, np - tp as fp, ng - tp as fn, round(tp / (tp + (np - tp) / 2.0 + (ng - tp) / 2.0), 6) as rq, round(s / (tp + 1e-6), 6) as sq, round(tp / (tp + (np - tp) / 2.0 + (ng - tp) / 2.0) * s / (tp + 1e-6), 6) as pq from h, k""")
def panoptic_quality(s, d):
    x = t(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("g"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("p"))
    return M.panoptic(x, "g", "p", 0.1).select("tp", "fp", "fn", r6("rq").alias("rq"), r6("sq").alias("sq"), r6("pq").alias("pq"))


@query("select o_orderkey, cast(dense_rank() over (order by o_custkey) as bigint) as instance from orders")
def remap_instance_ids(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey")
    ids = row_index(o.select("o_custkey").distinct(), ["o_custkey"])
    return o.join(ids, "o_custkey").select("o_orderkey", (F.col("row_idx") + 1).alias("instance"))


@query("select case_id, round(max, 6) as max, round(mean, 6) as mean, round(median, 6) as median, round(min, 6) as min, round(stdev, 6) as stdev, round(p0, 6) as percentile_00_5, round(p1, 6) as percentile_10_0, round(p2, 6) as percentile_90_0, round(p3, 6) as percentile_99_5 from (select l_orderkey as case_id, max(l_extendedprice) max, avg(l_extendedprice) mean, quantile_disc(l_extendedprice, 0.5) median, min(l_extendedprice) min, stddev_pop(l_extendedprice) stdev, quantile_cont(l_extendedprice, 0.005) p0, quantile_cont(l_extendedprice, 0.1) p1, quantile_cont(l_extendedprice, 0.9) p2, quantile_cont(l_extendedprice, 0.995) p3 from lineitem group by 1)")
def case_stats(s, d):
    x = P.case_stats(t(s, d, "lineitem").withColumnRenamed("l_orderkey", "case_id"), ["case_id"], "l_extendedprice")
    return x.select("case_id", *[r6(c).alias(c) for c in x.columns if c != "case_id"])


@query("with c as (select l_orderkey, max(l_extendedprice) max, avg(l_extendedprice) mean, quantile_disc(l_extendedprice, 0.5) median, min(l_extendedprice) min, stddev_pop(l_extendedprice) stdev, quantile_cont(l_extendedprice, 0.005) p0, quantile_cont(l_extendedprice, 0.1) p1, quantile_cont(l_extendedprice, 0.9) p2, quantile_cont(l_extendedprice, 0.995) p3 from lineitem group by 1) select round(max(max), 4) as max, round(min(min), 4) as min, round(avg(mean), 4) as mean, round(avg(median), 4) as median, round(avg(stdev), 4) as stdev, round(avg(p0), 4) as percentile_00_5, round(avg(p1), 4) as percentile_10_0, round(avg(p2), 4) as percentile_90_0, round(avg(p3), 4) as percentile_99_5 from c")
def summary_stats(s, d):
    x = P.summary_stats(P.case_stats(t(s, d, "lineitem"), ["l_orderkey"], "l_extendedprice"))
    return x.select(*[F.round(c, 4).alias(c) for c in x.columns])


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, count(value) as n from events where not isnan(value) group by 1")
def intensity_stats(s, d):
    x = P.intensity_stats(t(s, d, "events"), ["event_type"], "value")
    return x.select("event_type", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", "n")


@query("select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, min(l_quantity) as min, max(l_quantity) as max, round(stddev_pop(l_quantity), 6) as stdev, round(count(*) / sum(count(*)) over (), 6) as share from lineitem group by 1")
def label_stats(s, d):
    x = P.label_stats(t(s, d, "lineitem"), "l_returnflag", "l_quantity")
    return x.select("l_returnflag", "n", r6("mean").alias("mean"), "min", "max", r6("stdev").alias("stdev"), r6("share").alias("share"))


@query("with x as (select l_extendedprice v from lineitem qualify (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - 1) % 10 = 0) select round(quantile_cont(v, 0.005), 6) as p005, round(quantile_cont(v, 0.5), 6) as p500, round(quantile_cont(v, 0.995), 6) as p995, count(*) as n from x")
def dataset_percentiles(s, d):
    x = P.every_nth(t(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], 10)
    p = percentiles(x, "l_extendedprice", [], [0.5, 50, 99.5]).withColumn("n", F.lit(x.count()).cast("long"))
    return p.select(r6(F.col("p")[0]).alias("p005"), r6(F.col("p")[1]).alias("p500"), r6(F.col("p")[2]).alias("p995"), "n")


_REPORT = "with per as (select l_orderkey, l_returnflag as class_id, avg(l_discount) as value from lineitem group by 1, 2), raw as (select l_orderkey, class_id, value from per union all select l_orderkey, 'mean', avg(value) from per group by 1) "


@query(_REPORT + "select l_orderkey, class_id, round(value, 6) as value from raw")
def metrics_report_raw(s, d):
    raw, _ = P.metrics_report(t(s, d, "lineitem").withColumnRenamed("l_returnflag", "class_id"), "l_orderkey", "class_id", "l_discount")
    return raw.select("l_orderkey", "class_id", r6("value").alias("value"))


@query(_REPORT + "select class_id, round(avg(value), 6) as mean, round(median(value), 6) as median, round(max(value), 6) as max, round(quantile_cont(value, 0.9), 6) as p90, round(stddev_pop(value), 6) as std, count(value) as n from raw group by 1")
def metrics_report_summary(s, d):
    _, x = P.metrics_report(t(s, d, "lineitem").withColumnRenamed("l_returnflag", "class_id"), "l_orderkey", "class_id", "l_discount")
    return x.select("class_id", *[r6(c).alias(c) for c in ("mean", "median", "max", "p90", "std")], "n")


@query("with x as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) select o_custkey, o_orderkey, o_totalprice, cast(r as int) as r from x where r <= 3")
def best_n(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(s, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "r")


@query("select o_orderpriority as fold, max(o_totalprice) as best, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as o_orderkey from orders group by 1")
def best_by_fold(s, d):
    o = t(s, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("fold")).agg(F.max("o_totalprice").alias("best"), F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("a"), "o_orderkey")).alias("o_orderkey"))


@query("select l_partkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) // count(*) as bigint) as cents, count(distinct l_suppkey) as members from lineitem group by 1")
def mean_ensemble(s, d):
    return t(s, d, "lineitem").groupBy("l_partkey").agg(F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) div count(*)").alias("cents"), F.countDistinct("l_suppkey").alias("members"))


@query("with v as (select l_partkey, l_returnflag, count(*) c from lineitem group by 1, 2) select l_partkey, arg_min(l_returnflag, (-c, l_returnflag)) as vote, max(c) as votes from v group by 1")
def vote_ensemble(s, d):
    v = t(s, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("c"))
    return v.groupBy("l_partkey").agg(F.min_by("l_returnflag", F.struct((-F.col("c")).alias("a"), "l_returnflag")).alias("vote"), F.max("c").alias("votes"))


@query("""with x as (select l_orderkey, l_linenumber, l_returnflag = 'R' as pos, l_extendedprice as loss, l_partkey from lineitem), p as (select l_orderkey, 3 * sum(cast(pos as int)) as most from x group by 1), n as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by loss desc, l_linenumber, l_partkey) r from x where not pos)
select l_orderkey, l_linenumber from n join p using (l_orderkey) where r <= greatest(most, 1)""")
def hard_negative_topk(s, d):
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("pos"), F.col("l_extendedprice").alias("loss"), "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("pos", F.desc("loss"), "l_linenumber", "l_partkey")
    x = x.withColumn("most", 3 * F.sum(F.col("pos").cast("int")).over(Window.partitionBy("l_orderkey"))).withColumn("r", F.row_number().over(w))
    return x.where(~F.col("pos") & (F.col("r") <= F.greatest("most", F.lit(1)))).select("l_orderkey", "l_linenumber")


@query("""with m as (select cast(ts as date) as day, avg(value) v from events group by 1), b as (select *, max(v) over (order by day rows between unbounded preceding and 1 preceding) best from m), g as (select *, v > coalesce(best, -1e300) as better from b), r as (select *, sum(cast(better as int)) over (order by day) run from g)
select day, round(v, 6) as value, better, cast(count(*) over (partition by run order by day) - 1 as bigint) as waited, (count(*) over (partition by run order by day) - 1) >= 3 as stop from r""")
def early_stop(s, d):
    m = t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    up = Window.orderBy("day")  # one row for each day
    m = m.withColumn("best", F.max("v").over(up.rowsBetween(Window.unboundedPreceding, -1))).withColumn("better", F.col("v") > F.coalesce("best", F.lit(-1e300)))
    m = m.withColumn("run", F.sum(F.col("better").cast("int")).over(up))
    m = m.withColumn("waited", F.count("*").over(Window.partitionBy("run").orderBy("day")) - 1)
    return m.select("day", r6("v").alias("value"), "better", "waited", (F.col("waited") >= 3).alias("stop"))


@query("select conv_id, count(*) as seen, max(turn) + 1 as expected, count(*) >= max(turn) + 1 as complete from conversations group by 1")
def prob_map_completion(s, d):
    x = t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("seen"), (F.max("turn") + 1).alias("expected"))
    return x.withColumn("complete", F.col("seen") >= F.col("expected"))


@query("select vec_id, label, round((select avg(abs(cast(x as double) - b.label / 9.0)) from unnest(b.embedding) as u(x)), 6) as gap from embeddings b")
def label_quality(s, d):
    """Mean absolute difference of each record's predictions and its own label."""
    e = t(s, d, "embeddings")
    gap = F.transform(A.as_doubles(F.col("embedding")), lambda x: F.abs(x - F.col("label") / 9.0))
    return e.select("vec_id", "label", r6(A.mean(gap)).alias("gap"))
