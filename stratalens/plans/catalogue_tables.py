"""Queries of table loading, dataset operations, records and intensity."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import intensity as I
from stratalens.operators import datasets as D
from stratalens.operators import records as R
from stratalens.operators import tables as T
from stratalens.plans.registry import query
from stratalens.session import read_table as t


def r6(c):
    return F.round(c, 6)


@query("select c_custkey, c_name, o_orderkey, o_totalprice, n_name from customer join orders on c_custkey = o_custkey join nation on c_nationkey = n_nationkey")
def csv_join_tables(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    o = t(s, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")
    out = T.join_tables([T.join_tables([c, o], on="key"), t(s, d, "nation").select("n_nationkey", "n_name")], on="n_nationkey")
    return out.select(F.col("key").alias("c_custkey"), "c_name", "o_orderkey", "o_totalprice", "n_name")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey in (3, 77) union all select c_custkey, c_name, c_acctbal from customer where c_custkey >= 10 and c_custkey < 200")
def csv_select_rows_cols(s, d):
    return T.select_rows(t(s, d, "customer"), "c_custkey", [3, 77, (10, 200)]).select("c_custkey", "c_name", "c_acctbal")


@query("select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(lang, 'none') as lang, cast(coalesce(quality, -1) as double) as quality, cast(coalesce(toxic, 0) as bigint) as toxic from documents a full join labels b on a.doc_id = b.doc_id")
def csv_outer_defaults(s, d):
    x = T.join_tables([t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels")], on="doc_id", how="outer")
    return T.fill_and_cast(x, {"lang": {"default": "none"}, "quality": {"default": -1, "type": "double"}, "toxic": {"default": 0, "type": "bigint"}}).select("doc_id", "lang", "quality", "toxic")


@query("select l_orderkey, l_linenumber, concat_ws(',', round(l_quantity, 2), round(l_discount, 2)) as ehr, round(l_quantity, 6) as e0, round(l_tax, 6) as e2 from lineitem")
def csv_col_groups(s, d):
    x = T.group_columns(t(s, d, "lineitem"), {"ehr": ["l_quantity", "l_discount", "l_tax"]})
    e = F.col("ehr")
    return x.select("l_orderkey", "l_linenumber", F.concat_ws(",", F.round(e[0], 2).cast("string"), F.round(e[1], 2).cast("string")).alias("ehr"), r6(e[0]).alias("e0"), r6(e[2]).alias("e2"))


@query("select c_custkey, c_name, o_orderkey, o_totalprice, case when o_orderkey is null then 'left_only' when c_custkey is null then 'right_only' else 'both' end as side from customer full join orders on c_custkey = o_custkey")
def join_left_right_on(s, d):
    """Keys of different names, the left one checked to be unique, with the side that each row comes from."""
    c, o = t(s, d, "customer").select("c_custkey", "c_name"), t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    x = T.join_tables([c, o], left_on="c_custkey", right_on="o_custkey", how="outer", indicator="side", validate="one_to_many")
    return x.select("c_custkey", "c_name", "o_orderkey", "o_totalprice", "side")


@query("select cast(place as int) as place, c_custkey, c_name from (values (0, 77, 78), (1, 3, 4), (2, 70, 80), (3, 77, 78)) v(place, lo, hi) join customer on c_custkey >= lo and c_custkey < hi")
def row_indices_ordered(s, d):
    """Labels and ranges in the order of their list; a row that is listed twice comes twice."""
    return T.select_rows(t(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", [77, 3, (70, 80), 77], order="place").select("place", "c_custkey", "c_name")


@query("""with o as (select *, (row_number() over (order by o_orderkey) - 1) // 1000 as chunk from orders), c as (select *, (row_number() over (order by c_custkey) - 1) // 1000 as chunk from customer)
select o_orderkey, c_custkey, cast(o.chunk as bigint) as chunk from o join c on o_custkey = c_custkey and o.chunk = c.chunk""")
def chunked_join(s, d):
    chunk = F.floor(F.col("row_idx") / 1000).cast("long")
    o = D.row_index(t(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).withColumn("chunk", chunk)
    c = D.row_index(t(s, d, "customer").select("c_custkey"), ["c_custkey"]).withColumn("chunk", chunk)
    return o.withColumnRenamed("o_custkey", "c_custkey").drop("row_idx").join(c.drop("row_idx"), ["c_custkey", "chunk"]).select("o_orderkey", "c_custkey", "chunk")


@query("""select cast(a.i as bigint) as row_idx, s_suppkey, p_partkey from (select row_number() over (order by s_suppkey) - 1 as i, s_suppkey from supplier) a join (select row_number() over (order by p_partkey) - 1 as i, p_partkey from part) b on a.i = b.i""")
def zip_positional(s, d):
    return D.zip_rows(t(s, d, "supplier").select("s_suppkey"), t(s, d, "part").select("p_partkey"), ["s_suppkey"], ["p_partkey"]).select("row_idx", "s_suppkey", "p_partkey")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'events/' || event_id as image from events")
def datalist_explode(s, d):
    x = t(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return x.select("event_id", F.col("p.k").alias("k"), F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("image"))


@query("select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) % 5 as int) as part, cast((row_number() over (order by o_orderkey) - 1) // 5 as bigint) as position from orders")
def partition_strided(s, d):
    return D.partition_strided(D.row_index(t(s, d, "orders").select("o_orderkey"), ["o_orderkey"]), 5).select("o_orderkey", "part", "position")


@query("""with x as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders), b as (select *, least(n, cast(floor(0.3 * n + 0.5) as bigint)) as b0 from x), c as (select *, least(n, b0 + cast(floor(0.2 * n + 0.5) as bigint)) as b1 from b), e as (select *, least(n, b1 + cast(floor(0.5 * n + 0.5) as bigint)) as b2 from c)
select o_orderkey, case when i < b0 then 0 when i < b1 then 1 else 2 end as part from e where i < b2""")
def partition_ratios(s, d):
    o = t(s, d, "orders").select("o_orderkey")
    return D.partition_ratios(D.row_index(o, ["o_orderkey"]), [3, 2, 5], o.count()).select("o_orderkey", "part")


@query("""with x as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i, count(*) over () as n from supplier), y as (select s_suppkey, i from x union all select s_suppkey, i + n from x where i < ((n + 6) // 7) * 7 - n)
select s_suppkey, cast(i % 7 as int) as part, cast(i // 7 as bigint) as position from y""")
def partition_even(s, d):
    x = t(s, d, "supplier").select("s_suppkey")
    return D.partition_even(D.row_index(x, ["s_suppkey"]), 7, x.count()).select("s_suppkey", "part", "position")


@query("select vec_id, label, cast((row_number() over (partition by label order by vec_id) - 1) % 4 as int) as part from embeddings")
def partition_stratified(s, d):
    return D.partition_stratified(t(s, d, "embeddings").select("vec_id", "label"), "label", 4, "vec_id")


@query("""with x as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i, count(*) over () as n from supplier)
select s_suppkey, cast(k as int) as copy from x, unnest(range(0, case when i < floor(n * 0.5 + 0.5) then 3 else 2 end)) as u(k)""")
def resample_factor(s, d):
    x = t(s, d, "supplier").select("s_suppkey")
    return D.resample(D.row_index(x, ["s_suppkey"]), 2.5, x.count()).select("s_suppkey", "copy")


@query("select doc_id, cast((row_number() over (order by doc_id) - 1) % 5 as int) as fold, case when (row_number() over (order by doc_id) - 1) % 5 = 2 then 'validation' else 'training' end as use from documents")
def cv_folds(s, d):
    x = D.cross_validation(D.row_index(t(s, d, "documents").select("doc_id"), ["doc_id"]), 5)
    return x.select("doc_id", "fold", F.when(F.col("fold") == 2, "validation").otherwise("training").alias("use"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def missing_files_anti(s, d):
    return T.missing_keys(t(s, d, "documents").select("doc_id", "source"), t(s, d, "labels"), "doc_id")


@query("select min(doc_id) as first_idx, max(doc_id) as last_idx, count(*) as n from documents group by text, lang")
def dedup_by_hash(s, d):
    return D.dedup_by_hash(t(s, d, "documents").select("doc_id", "text", "lang"), ["text", "lang"], "doc_id").select("first_idx", "last_idx", "n")


@query("""with x as (select *, row_number() over (order by event_id) - 1 as i from events)
select cast(i // 32 as bigint) as batch, count(*) as n, min(event_id) as first_id, round(sum(value), 6) as total, string_agg(event_type, ',' order by i) as kinds from x group by i // 32""")
def batch_collate(s, d):
    x = D.batches(D.row_index(t(s, d, "events").select("event_id", "event_type", "value"), ["event_id"]), 32)
    return x.select("batch", F.col("n").cast("long").alias("n"), F.col("event_id")[0].alias("first_id"), r6(F.aggregate("value", F.lit(0.0), lambda a, b: a + b)).alias("total"), F.array_join("event_type", ",").alias("kinds"))


@query("select conv_id, turn, role, text from conversations")
def decollate(s, d):
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    stacked = rows.select("conv_id", F.col("r.turn").alias("turn"), F.col("r.role").alias("role"), F.col("r.text").alias("text"))
    return stacked.select("conv_id", F.explode(F.arrays_zip("turn", "role", "text")).alias("r")).select("conv_id", "r.turn", "r.role", "r.text")


@query("select p_partkey, p_size, p_size as size_0, p_partkey as key_0 from part")
def select_copy_delete(s, d):
    x = R.select_items(t(s, d, "part"), ["p_partkey", "p_size", "p_brand"])
    return R.delete_items(R.copy_items(x, ["p_size", "p_partkey"], 1, ["size_0", "key_0"]), ["p_brand"])


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as props_k from events")
def flatten_subkeys(s, d):
    x = t(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return R.flatten_sub_keys(x, "props", ["k"], prefix="props")


@query("select o_orderkey, case o_orderstatus when 'O' then 'F' when 'F' then 'P' else o_orderstatus end as status from orders")
def map_label_value(s, d):
    return t(s, d, "orders").select("o_orderkey", R.map_labels(F.col("o_orderstatus"), {"O": "F", "F": "P"}).alias("status"))


@query("select vec_id, case when label in (1, 3, 5) then label else 0 end as kept, case when label in (2, 4) then 1 else 0 end as mask from embeddings")
def label_filter(s, d):
    c = F.col("label")
    return t(s, d, "embeddings").select("vec_id", R.label_filter(c, [1, 3, 5]).alias("kept"), R.label_to_mask(c, [2, 4]).alias("mask"))


@query("select event_id, round(case when value > 50 then value else 0 end, 6) as above, round(case when value < 50 then value else -1 end, 6) as below from events")
def threshold_intensity(s, d):
    v = F.col("value")
    return t(s, d, "events").select("event_id", r6(I.threshold_intensity(v, 50.0)).alias("above"), r6(I.threshold_intensity(v, 50.0, above=False, fill=-1.0)).alias("below"))


@query("""with x as (select *, min(l_quantity) over (partition by l_orderkey) lo, max(l_quantity) over (partition by l_orderkey) hi from lineitem)
select l_orderkey, l_linenumber, round(case when hi = lo then l_quantity * 0 else (l_quantity - lo) / (hi - lo) end, 6) as scaled from x""")
def scale_minmax(s, d):
    return I.scale_minmax(t(s, d, "lineitem"), "l_quantity", ["l_orderkey"], "scaled", small_groups=True).select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"))


@query("select p_partkey, round(least(greatest((p_retailprice - 1000) / 500 * 2 - 1, -1), 1), 6) as scaled from part")
def scale_range_clip(s, d):
    return t(s, d, "part").select("p_partkey", r6(I.scale_range(F.col("p_retailprice"), 1000.0, 1500.0, -1.0, 1.0, clip=True)).alias("scaled"))


@query("""with p as (select l_returnflag, quantile_cont(l_extendedprice, 0.05) lo, quantile_cont(l_extendedprice, 0.95) hi from lineitem group by 1)
select l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - lo) / (hi - lo), 0), 1), 6) as scaled from lineitem join p using (l_returnflag)""")
def scale_range_percentiles(s, d):
    x = I.scale_range_percentiles(t(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"], 5, 95, 0.0, 1.0, "scaled", clip=True)
    return x.select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"))


@query("""with p as (select event_type, quantile_cont(value, 0.1) lo, quantile_cont(value, 0.9) hi from events group by 1)
select event_id, round(least(greatest(value, lo), hi), 6) as clipped from events join p using (event_type)""")
def clip_percentiles(s, d):
    e = t(s, d, "events").select("event_id", "event_type", "value")
    x = e.join(I.group_percentiles(e, "value", ["event_type"], [10, 90]), "event_type")
    return x.select("event_id", r6(F.least(F.greatest("value", F.col("p")[0]), F.col("p")[1])).alias("clipped"))


@query("select event_id, round(value + ln(1 + exp(-0.1 * (value - 20))) / 0.1 - ln(1 + exp(0.1 * (value - 80))) / 0.1, 6) as clipped from events")
def soft_clip(s, d):
    return t(s, d, "events").select("event_id", r6(I.soft_clip(F.col("value"), F.lit(20.0), F.lit(80.0), 0.1)).alias("clipped"))


@query("""select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over w) / (case when stddev_pop(l_quantity) over w = 0 then 1 else stddev_pop(l_quantity) over w end), 6) as z,
round(case when l_discount = 0 then 0 else (l_discount - avg(nullif(l_discount, 0)) over w) / (case when stddev_pop(nullif(l_discount, 0)) over w = 0 then 1 else stddev_pop(nullif(l_discount, 0)) over w end) end, 6) as nz from lineitem window w as (partition by l_returnflag)""")
def normalize_z(s, d):
    x = I.normalize_all(t(s, d, "lineitem"), {"l_quantity": ("z", False), "l_discount": ("nz", True)}, ["l_returnflag"])
    return x.select("l_orderkey", "l_linenumber", r6("z").alias("z"), r6("nz").alias("nz"))


@query("select event_id, round(value + 0.5 * stddev_pop(value) over (partition by event_type), 6) as shifted from events")
def std_shift(s, d):
    return I.std_shift(t(s, d, "events"), "value", ["event_type"], 0.5, "shifted").select("event_id", r6("shifted").alias("shifted"))


@query("select event_id, round((value - avg(value) over (partition by event_type)) * 1.2 + avg(value) over (partition by event_type), 6) as scaled from events")
def fixed_mean_scale(s, d):
    return I.fixed_mean_scale(t(s, d, "events"), "value", ["event_type"], 0.2, "scaled").select("event_id", r6("scaled").alias("scaled"))


@query("""with x as (select *, min(value) over (partition by event_type) lo, max(value) over (partition by event_type) - min(value) over (partition by event_type) span from events)
select event_id, round(pow((value - lo) / (span + 1e-7), 1.5) * span + lo, 6) as adjusted from x""")
def adjust_contrast(s, d):
    return I.adjust_contrast(t(s, d, "events"), "value", ["event_type"], 1.5, "adjusted").select("event_id", r6("adjusted").alias("adjusted"))


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then l_extendedprice else 0 end as masked from lineitem")
def mask_intensity(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", I.mask_intensity(F.col("l_extendedprice"), F.col("l_returnflag") == "R").alias("masked"))


@query("select event_type, cast(least(floor((value - 0) / (100 - 0) * 20), 19) as int) as bin, count(*) as n from events where value >= 0 and value <= 100 group by 1, 2")
def histogram_fixed(s, d):
    return I.histogram(t(s, d, "events"), "value", ["event_type"], 0.0, 100.0, 20)


@query("""with r as (select min(value) lo, max(value) hi from events), b as (select cast(least(floor((value - lo) / (hi - lo) * 50), 49) as int) as bin, count(*) n from events, r group by 1), c as (select k, sum(coalesce(n, 0)) over (order by k) as c from range(50) t(k) left join b on bin = k),
l as (select k, (c - min(c) over ()) / (max(c) over () - min(c) over ()) * 255 as level from c), x as (select event_id, (value - lo) / ((hi - lo) / 50) - 0.5 as place from events, r), y as (select *, least(greatest(floor(place), 0), 48) as k from x)
select event_id, round(p.level + (q.level - p.level) * least(greatest(place - y.k, 0), 1), 6) as equalized from y join l p on p.k = y.k join l q on q.k = y.k + 1""")
def histogram_equalize(s, d):
    return I.equalize_histogram(t(s, d, "events").select("event_id", "value"), "value", 50, "equalized").select("event_id", r6("equalized").alias("equalized"))


@query("select md5(concat('7:', event_id)) as shuffle_key, event_id, cast((row_number() over (order by md5(concat('7:', event_id))) - 1) % 4 as int) as rank from events")
def distributed_sampler(s, d):
    x = D.row_index(D.hash_shuffle(t(s, d, "events").select("event_id"), "event_id", 7), ["shuffle_key"])
    n = x.count()
    x = D.partition_even(x, 4, n) if n else D.partition_strided(x, 4)
    return x.select("shuffle_key", "event_id", F.col("part").alias("rank"))


@query("""with x as (select l_orderkey, l_linenumber, sum(l_quantity) over (order by l_orderkey, l_linenumber) hi, l_quantity w, sum(l_quantity) over () total from lineitem), u as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double as u)
select l_orderkey, l_linenumber, u from x join u on u * total >= hi - w and u * total < hi""")
def weighted_sample_cdf(s, d):
    rows = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"))
    draws = [0.05, 0.25, 0.5, 0.75, 0.95]
    return D.weighted_draws(rows, "l_quantity", draws, "k", 100_000).select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, draws)), F.col("draw") + 1).alias("u"))
