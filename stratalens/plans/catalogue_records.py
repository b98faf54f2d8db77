"""Queries of array functions, annotation records, evaluation logs, data lists and file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import points as PO
from stratalens.functions import tensors as X
from stratalens.functions import unified as U
from stratalens.functions.nd import Nd
from stratalens.operators import detection as D
from stratalens.operators import interactive as IA
from stratalens.operators import profiling as P
from stratalens.plans import evaluation as EV
from stratalens.plans.catalogue_arrays import BOXES, boxes, vectors
from stratalens.plans.catalogue_detection import unit_sql
from stratalens.plans.registry import query
from stratalens.session import read_table as t
from stratalens.sources import formats as FM
from stratalens.sources import readers as RD
from stratalens.sources import sinks as SK
from stratalens.storage import new_path

_V = "with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) "
_E = "with e as (select vec_id, cast(i as int) as i, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) "


def r6(c):
    return F.round(c, 6)


def total(a):
    return F.aggregate(a, F.lit(0.0), lambda p, q: p + q)


def classes(s, d):
    """Each array as labels 0 to 4."""
    return vectors(s, d).select("vec_id", F.transform("v", lambda x: (F.floor(F.abs(x) * 20) % 5).cast("int")).alias("c"), "v")


_C = _E[:-1] + ", c as (select vec_id, i, x, cast(floor(abs(x) * 20) as int) % 5 as c from e) "


@query(_V + "select vec_id, list_max(v[1:2]) = list_min(v[1:2]) as constant, len(list_filter(v, lambda x: x > 0)) as positives, round(list_sum(list_transform(v, lambda x: floor(x / 0.1))), 6) as floors, len(list_filter(v[1:3], lambda x: floor(abs(x) * 10) <> 0)) > 0 as any_left, round(list_sum(list_transform(range(0, 128), lambda i: v[i // 2 + 1] * (i + 1))), 4) as repeated, round(v[5] - v[1], 6) as stacked from e")
def unified_arrays(s, d):
    """Constant, positive, floor division, any, repeat and stack."""
    v = F.col("v")
    weigh = lambda a: total(F.transform(a, lambda x, i: x * (i + 1)))
    return vectors(s, d).select(
        "vec_id",
        U.is_empty(F.slice(v, 1, 2)).alias("constant"),
        total(F.transform(U.positive(v), lambda x: x.cast("double"))).cast("long").alias("positives"),
        r6(total(F.transform(U.floor_divide(v, 0.1), lambda x: x.cast("double")))).alias("floors"),
        U.any_nonzero(F.transform(F.slice(v, 1, 3), lambda x: F.floor(F.abs(x) * 10))).alias("any_left"),
        F.round(weigh(U.repeat(v, 2)), 4).alias("repeated"),
        r6(U.stack(F.slice(v, 1, 4), F.slice(v, 5, 4))[1][0] - U.stack(F.slice(v, 1, 4), F.slice(v, 5, 4))[0][0]).alias("stacked"),
    )


@query(_C + "select vec_id, count(*) filter (where c in (1, 4)) as core, count(*) filter (where c in (1, 2, 4)) as whole, count(*) filter (where c = 4) as enhancing from c group by 1")
def tumour_channels(s, d):
    n = lambda k: total(F.transform(U.brats_channels(F.col("c"))[k], lambda x: x.cast("double"))).cast("long")
    return classes(s, d).select("vec_id", n(0).alias("core"), n(1).alias("whole"), n(2).alias("enhancing"))


@query(_C + "select vec_id, string_agg(distinct c, ',' order by c) as there, least(greatest(3 * (vec_id % 3), 2), 6) as y, least(greatest(vec_id % 9, 1), 6) as x from c group by 1")
def labels_and_crop_centres(s, d):
    """Labels that an array holds, and the middle of a 4 x 3 crop moved inside."""
    y, x = PO.center_within([3 * (F.col("vec_id") % 3), F.col("vec_id") % 9], (4, 3), (8, 8))
    return classes(s, d).select("vec_id", F.array_join(PO.labels_present(F.col("c")), ",").alias("there"), y.cast("long").alias("y"), x.cast("long").alias("x"))


@query(_E + "select vec_id, cast(i // 8 as int) as slice, round(sum(x), 6) as total from e where (vec_id, i // 8) in (select vec_id, i // 8 from e where x > 0.12) group by 1, 2")
def interactive_slices(s, d):
    """Slices with foreground, each fetched."""
    image = Nd(F.col("v"), (8, 8))
    x = vectors(s, d).withColumn("slice", F.explode(IA.valid_slices(image, 0.12)))
    return x.select("vec_id", "slice", r6(total(IA.fetch_slice(image, F.col("slice")).data)).alias("total"))


_CLICKS = _E[:-1] + f""", m as (select vec_id, coalesce(list(i order by i) filter (where x > 0.1), []) as a, coalesce(list(i order by i) filter (where x < -0.1), []) as b from e group by 1),
k as (select vec_id, a, b, {unit_sql('vec_id', '61')} as u, {unit_sql('vec_id', '62')} as w, {unit_sql('vec_id', '61p')} < 0.7 as asked from m) """


@query(_CLICKS + "select vec_id, case when len(a) > 0 then a[cast(floor(u * len(a)) as int) + 1] end as seed, case when asked and len(a) > 0 then a[cast(floor(u * len(a)) as int) + 1] end as positive, case when asked and len(a) = 0 and len(b) > 0 then b[cast(floor(w * len(b)) as int) + 1] end as negative from k")
def interactive_clicks(s, d):
    """A seed point in a label, and clicks added where a prediction misses it or strays."""
    missed, wrong = F.transform("v", lambda x: (x > 0.1).cast("int")), F.transform("v", lambda x: (x < -0.1).cast("int"))
    pos, neg = IA.random_guidance(missed, wrong, "vec_id", 0.7, 61)
    return vectors(s, d).select("vec_id", IA.seed_point(U.nonzero(missed), "vec_id", 61).cast("int").alias("seed"), pos.cast("int").alias("positive"), neg.cast("int").alias("negative"))


@query(_E + "select vec_id, cast(i // 8 as int) as slice, count(*) as clicks, cast(sum(i % 8) as bigint) as columns from e where x > 0.12 group by 1, 2")
def interactive_split_clicks(s, d):
    """Clicks by the slice that they lie on."""
    at = F.transform(U.argwhere(F.col("v"), lambda x: x > 0.12), lambda i: F.array(F.floor(i / 8).cast("int"), (i % 8).cast("int")))
    x = vectors(s, d).select("vec_id", F.explode(IA.split_clicks(at, lambda c: c[0])).alias("slice", "c"))
    return x.select("vec_id", "slice", F.size("c").cast("long").alias("clicks"), F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c[1]).alias("columns"))


@query(_C + "select vec_id, count(*) filter (where c = 1) as low, count(*) filter (where c = 3) as high, count(*) filter (where c = 2) as own, 7 * count(*) filter (where c not in (0, 2)) as others from c group by 1")
def interactive_splits(s, d):
    """A prediction split by labels, and a label into one instance and the others."""
    x = IA.split_predictions(classes(s, d), "c", {"low": 1, "high": 3})
    own, others = IA.split_label(F.col("c"), 2, 7)
    n = lambda c: total(F.transform(c, lambda v: v.cast("double"))).cast("long")
    return x.select("vec_id", n(F.col("c_low")).alias("low"), n(F.col("c_high")).alias("high"), n(own).alias("own"), n(others).alias("others"))


@query(_E + "select vec_id, count(*) filter (where x > 0.12) as own, count(*) filter (where x > 0.05 and x <= 0.12) as others, cast(coalesce(sum(i) filter (where x > 0.12), 0) as bigint) as places from e group by 1")
def interactive_click_channels(s, d):
    """Channels of clicks on an instance and on others but not on it."""
    at = lambda test: F.transform(U.argwhere(F.col("v"), test), lambda i: F.array(F.floor(i / 8).cast("int"), (i % 8).cast("int")))
    own, others = IA.click_channels((8, 8), at(lambda x: x > 0.12), at(lambda x: x > 0.05))
    n = lambda c: total(F.transform(c, lambda v: v.cast("double"))).cast("long")
    return vectors(s, d).select("vec_id", n(own).alias("own"), n(others).alias("others"), n(F.transform(own, lambda v, i: v * i)).alias("places"))


@query(_C + f", g as (select distinct vec_id, c from c where c not in (0, 3)), o as (select *, row_number() over (partition by vec_id order by {unit_sql("concat(vec_id, '/', c)", '71')}, c) as k from g) select e.vec_id, coalesce(string_agg(o.c, ',' order by o.c) filter (where k <= 2), '') as classes from (select distinct vec_id from e) e left join o using (vec_id) group by 1")
def interactive_prompt_classes(s, d):
    """Two drawn classes of those that an array holds, without background and a special one."""
    return classes(s, d).select("vec_id", F.array_join(IA.prompt_classes(F.col("c"), [3], "vec_id", 2, 71), ",").alias("classes"))


@query(BOXES + "select image_id, box_id, round(ymin, 6) as xmin, round(xmin, 6) as ymin, round(ymax, 6) as xmax, round(xmax, 6) as ymax, 2 as axes, case when label = 1 then 0 else 4 end as numbers from b")
def boxes_swapped(s, d):
    """Boxes with their axes swapped; a missing box array counts as an empty one."""
    b = boxes(s, d)
    x = b.withColumn("a", F.when(F.col("label") != 1, F.array("xmin", "ymin", "xmax", "ymax"))).withColumn("numbers", F.size(D.no_box_is_empty(F.col("a"))))
    out = x.select("image_id", "box_id", "numbers", *[c.alias(n) for n, c in D.swap_axes("x", "y").items()])
    return out.select("image_id", "box_id", *[r6(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.lit(len(D.spatial_axes("ccwh"))).alias("axes"), "numbers")


@query("with m as (select e, avg(cast(embedding[1] as double) + case e when 0 then 0.1 when 1 then 0.3 when 2 then 0.3 else 0.2 end) as v from embeddings, unnest(range(4)) as u(e) group by 1) select cast(1 as int) as epoch, round((select v from m where e = 1), 6) as mean, true as stop_after_2, false as stop_after_3")
def evaluation_log(s, d):
    """Four epochs logged: the best one, and whether two or three without a gain stop the training."""
    path = new_path(s, "log")
    for epoch, gain in enumerate((0.1, 0.3, 0.3, 0.2)):
        e = EV.Evaluator("vec_id", {"p": lambda: F.col("v")[0]}, {"first": lambda p: p + F.col("gain")}, {"gain": F.lit(gain)})
        EV.log_metrics(e.summary(vectors(s, d)), epoch, path)
    log = s.read.parquet(path)
    best = EV.best_epoch(log, "first").withColumn("mean", r6("mean"))
    return best.withColumns({"stop_after_2": F.lit(EV.should_stop(log, "first", 2, least_gain=1e-6)), "stop_after_3": F.lit(EV.should_stop(log, "first", 3, least_gain=1e-6))})


@query("select p_size % 5 = 2 as validation, count(*) as n, cast(sum(p_partkey) as bigint) as keys from part group by 1")
def folds_read(s, d):
    """Training and validation by the fold that records name; some name none."""
    items = t(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 4, F.col("p_size") % 5).alias("fold"))
    train, valid = P.read_folds(items, 2)
    both = train.withColumn("validation", F.lit(False)).unionByName(valid.withColumn("validation", F.lit(True)))
    return both.groupBy("validation").agg(F.count("*").alias("n"), F.sum("p_partkey").cast("long").alias("keys"))


@query("select unnest(['image_stats.spacing', 'label_stats']) as missing, (select count(*) from part) as records")
def report_missing(s, d):
    """What a declared report format has and a table of reports lacks."""
    reports = t(s, d, "part").select(F.struct(F.col("p_size").alias("shape"), F.col("p_retailprice").alias("intensity")).alias("image_stats"))
    lacks = P.missing_from_report(reports, {"image_stats": {"shape": {}, "spacing": {}}, "label_stats": {"labels": {}}})
    return reports.agg(F.count("*").alias("records")).select(F.explode(F.array(*map(F.lit, lacks))).alias("missing"), "records")


_SSIM = _E[:-1] + """, p as (select vec_id, i // 8 as a, i % 8 as b, x as p, 0.8 * x + 0.05 * (i % 3) as q from e), h as (select vec_id, a // 2 as a, b // 2 as b, avg(p) as p, avg(q) as q from p group by all),
w as (select unnest([0, 1, 2]) as w), c as (select 0 as k, p.vec_id, p.a - u.w as r, p.b - v.w as c, p, q from p, w u, w v where p.a - u.w between 0 and 5 and p.b - v.w between 0 and 5 union all select 1, h.vec_id, h.a - u.w, h.b - v.w, p, q from h, w u, w v where h.a - u.w between 0 and 1 and h.b - v.w between 0 and 1),
s as (select k, vec_id, r, c, avg(p) as mx, avg(q) as my, avg(p * p) - avg(p) ** 2 as vx, avg(q * q) - avg(q) ** 2 as vy, avg(p * q) - avg(p) * avg(q) as cxy from c group by all),
t as (select k, vec_id, avg((2 * cxy + 0.0009) / (vx + vy + 0.0009) * case when k = 1 then (2 * mx * my + 0.0001) / (mx * mx + my * my + 0.0001) else 1 end) as t from s group by all)
select vec_id, round(max(greatest(t, 0) ** 0.4) filter (where k = 0) * max(greatest(t, 0) ** 0.6) filter (where k = 1), 5) as similarity from t group by 1"""


@query(_SSIM)
def multiscale_similarity(s, d):
    """Structural similarity over two scales."""
    import numpy as np
    import pyarrow as pa

    q = F.transform("v", lambda x, i: x * 0.8 + (i % 3) * 0.05)

    def run(it):
        for batch in it:
            out = [X.multiscale_ssim(np.array(p).reshape(8, 8), np.array(r).reshape(8, 8), 3, 1.0, (0.4, 0.6)) for p, r in zip(batch.column("v").to_pylist(), batch.column("q").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.float64())], ["vec_id", "similarity"])

    x = vectors(s, d).select("vec_id", "v", q.alias("q"))
    return x.mapInArrow(run, f"vec_id {dict(x.dtypes)['vec_id']}, similarity double").withColumn("similarity", F.round("similarity", 5))


@query(_E + "select vec_id, i as cell, round(x, 6) as value, 'data' as name from e union all select vec_id, cast(i as int), cast([2, 0, 0, -1, 0, 3, 0, 5, 0, 0, 1, 0, 0, 0, 0, 1][i + 1] as double), 'affine' from embeddings, unnest(range(16)) as u(i)")
def nifti_files(s, d):
    """Volumes with their affines written as compressed NIfTI, and read back from the bytes."""
    affine = F.array(*[F.lit(float(x)) for x in (2, 0, 0, -1, 0, 3, 0, 5, 0, 0, 1, 0, 0, 0, 0, 1)])
    rows = vectors(s, d).select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit(".nii.gz")).alias("name"), F.array(*map(F.lit, (4, 2, 8))).alias("shape"), F.col("v").alias("data"), affine.alias("affine"))
    files = SK.save_arrays(rows, new_path(s, "files"), suffix="nii.gz")
    back = RD.decode_arrays(files.withColumnRenamed("name", "path"))
    return back.select(F.regexp_extract("path", r"(\d+)\.nii", 1).cast("long").alias("vec_id"), F.posexplode("data").alias("cell", "value"), "name").withColumn("value", r6("value"))


@FM.register_writer("f64")
def _plain_bytes(a, affine=None):
    return a.astype("<f8").tobytes()


@RD.register_reader("f64")
def _from_plain_bytes(raw):
    import numpy as np

    return {"data": np.frombuffer(raw, "<f8")}


@query(_E + "select vec_id, i as cell, round(x, 6) as value from e")
def registered_formats(s, d):
    """A format that was registered by its suffix, written and read."""
    rows = vectors(s, d).select(F.concat(F.col("vec_id").cast("string"), F.lit(".f64")).alias("name"), F.array(F.lit(64)).alias("shape"), F.col("v").alias("data"))
    back = RD.decode_arrays(SK.save_arrays(rows, new_path(s, "files"), suffix="f64").withColumnRenamed("name", "path"))
    return back.select(F.regexp_extract("path", r"(\d+)\.f64", 1).cast("long").alias("vec_id"), F.posexplode("data").alias("cell", "value")).withColumn("value", r6("value"))


@query("select 'brands' as name, (select count(*) from part) as n, count(distinct p_brand) as training from part where p_size <= 25")
def datalist_read(s, d):
    """A data list in JSON of the brands of parts: its properties and its training section."""
    part = t(s, d, "part")
    path = new_path(s, "list")
    brands = part.where("p_size <= 25").select("p_brand").distinct()  # a few dozen
    items = brands.agg(F.collect_list(F.struct(F.col("p_brand").alias("image"))).alias("training"))
    items.crossJoin(part.agg(F.count("*").alias("n"))).select(F.lit("brands").alias("name"), "n", "training").coalesce(1).write.json(path)
    props = RD.datalist_properties(s, path, ["name", "n"])
    return props.crossJoin(RD.load_datalist(s, path, "training").agg(F.count("*").alias("training")))
