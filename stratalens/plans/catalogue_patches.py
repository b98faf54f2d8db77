"""Queries of patches in two and three dimensions, orientation, collation, array functions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import affines as AF
from stratalens.functions import arrays as A
from stratalens.functions import unified as U
from stratalens.functions.nd import Nd
from stratalens.operators import patches_nd as PN
from stratalens.plans.catalogue_arrays import vectors
from stratalens.plans.catalogue_detection import unit_sql
from stratalens.plans.evaluation import Evaluator
from stratalens.plans.registry import query

_E = "with e as (select vec_id, cast(i as int) as i, i // 8 as a, i % 8 as b, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) "


@query(_E + "select vec_id, cast(p as int) as a0, cast(q as int) as b0, round(sum(x), 5) as total from e, unnest([0, 2, 4]) as t(p), unnest([0, 2, 4]) as u(q) where a >= p and a < p + 4 and b >= q and b < q + 4 group by 1, 2, 3")
def patches_2d(s, d):
    """Half-overlapping 4 x 4 patches of 8 x 8 arrays."""
    x = PN.split(vectors(s, d), "v", (8, 8), (4, 4), PN.grid_starts((8, 8), (4, 4), 0.5))
    return x.select("vec_id", F.col("start")[0].alias("a0"), F.col("start")[1].alias("b0"), F.round(A.total(F.col("patch")), 5).alias("total"))


@query("with e as (select vec_id, i // 16 as a, i // 4 % 4 as b, i % 4 as c, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) select vec_id, cast(p as int) as a0, cast(q as int) as b0, cast(r as int) as c0, round(sum(x), 5) as total from e, unnest([0, 3]) as t(p), unnest([0, 3]) as u(q), unnest([0, 3]) as w(r) where a >= p and a < p + 3 and b >= q and b < q + 3 and c >= r and c < r + 3 group by 1, 2, 3, 4")
def patches_3d_padded(s, d):
    """3 x 3 x 3 patches that cover 4 x 4 x 4 arrays, zeros beyond them."""
    x = PN.split(vectors(s, d), "v", (4, 4, 4), (3, 3, 3), PN.grid_starts((4, 4, 4), (3, 3, 3), 0, padded=True))
    return x.select("vec_id", *[F.col("start")[k].alias(n) for k, n in enumerate(("a0", "b0", "c0"))], F.round(A.total(F.col("patch")), 5).alias("total"))


@query(_E + ", w as (select vec_id, i, x, p, q, greatest(exp(-(pow(a - p - 2, 2) + pow(b - q - 2, 2)) / (2 * 0.625 * 0.625)), 0.001) as w from e, unnest([0, 3]) as t(p), unnest([0, 3]) as u(q) where a >= p and a < p + 5 and b >= q and b < q + 5) select vec_id, i as cell, round(sum(w * x * (1 + p + q)) / sum(w), 4) as value from w group by 1, 2")
def sliding_window_2d(s, d):
    """Gaussian merge of 5 x 5 windows, each scaled by its place."""
    x = PN.split(vectors(s, d), "v", (8, 8), (5, 5), PN.window_starts((8, 8), (5, 5), 0.25))
    x = x.withColumn("patch", F.transform("patch", lambda v: v * (1 + F.col("start")[0] + F.col("start")[1])))
    return PN.merge(x, ["vec_id"], (5, 5), (8, 8), PN.importance((5, 5))).select("vec_id", "cell", F.round("value", 4).alias("value"))


@query(_E + ", w as (select vec_id, i, p, q, 2 * x - max(x) over (partition by vec_id, p, q) as y from e, unnest([0, 3]) as t(p), unnest([0, 3]) as u(q) where a >= p and a < p + 5 and b >= q and b < q + 5) select vec_id, i as cell, round(avg(y), 4) as value from w group by 1, 2")
def sliding_window_inference(s, d):
    """A user's function over all windows: twice the window less its greatest value."""
    x = PN.infer(vectors(s, d).select("vec_id", "v"), "v", ["vec_id"], (8, 8), (5, 5), lambda w: 2 * w - w.max(axis=(1, 2), keepdims=True))
    return x.select("vec_id", "cell", F.round("value", 4).alias("value"))


@query(_E + f", o as (select vec_id, cast(floor({unit_sql('vec_id', '9o0')} * 4) as int) as oa, cast(floor({unit_sql('vec_id', '9o1')} * 4) as int) as ob from embeddings), g as (select *, oa + 4 * p as a0, ob + 4 * q as b0 from o, unnest(range(2)) as t(p), unnest(range(2)) as u(q) where oa + 4 * p <= 4 and ob + 4 * q <= 4) select vec_id, cast(a0 as int) as a0, cast(b0 as int) as b0, round(sum(x), 5) as total from e join g using (vec_id) where a >= a0 and a < a0 + 4 and b >= b0 and b < b0 + 4 group by 1, 2, 3")
def random_grid_patches(s, d):
    x = PN.rand_grid(vectors(s, d), "v", "vec_id", (8, 8), (4, 4), 0, 9)
    return x.select("vec_id", F.col("start")[0].alias("a0"), F.col("start")[1].alias("b0"), F.round(A.total(F.col("patch")), 5).alias("total"))


@query("with e as (select vec_id, i // 16 as a, i // 4 % 4 as b, i % 4 as c, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) select vec_id, cast(c * 16 + (3 - a) * 4 + b as int) as cell, round(x, 5) as value from e")
def orient_axes(s, d):
    """4 x 4 x 4 arrays from axes RAS to axes SLA: the third axis first, the first one flipped, the second last."""
    y = AF.oriented(Nd(F.col("v"), (4, 4, 4)), "RAS", "SLA").data
    return vectors(s, d).select("vec_id", F.posexplode(y).alias("cell", "value")).withColumn("value", F.round("value", 5))


@query("with v as (select vec_id, vec_id // 10 as batch, 1 + vec_id % 3 as h, 1 + vec_id % 4 as w, embedding from embeddings), m as (select batch, max(h) as mh, max(w) as mw from v group by 1) select vec_id, cast(mh as int) as h, cast(mw as int) as w, round((select sum(cast(embedding[i * v.w + j + 1] as double) * (i * mw + j + 1)) from range(v.h) t(i), range(v.w) u(j)), 4) as checksum from v join m using (batch)")
def pad_collate(s, d):
    """Arrays of different shapes padded to the largest of their batch of ten."""
    i = lambda c: c.cast("int")
    h, w = i(1 + F.col("vec_id") % 3), i(1 + F.col("vec_id") % 4)
    x = vectors(s, d).select("vec_id", F.floor(F.col("vec_id") / 10).alias("batch"), F.array(h, w).alias("shape"), F.slice("v", F.lit(1), h * w).alias("data"))
    x = PN.pad_collate(x, "batch", "data", "shape", 2)
    total = F.aggregate(F.transform("data", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", F.col("shape")[0].alias("h"), F.col("shape")[1].alias("w"), F.round(total, 4).alias("checksum"))


_F = "with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v, list_transform(embedding, lambda x: cast(floor(x * 10) as int)) as w from embeddings) "


@query(_F + """select vec_id, list_sort(v)[32] + list_sort(v)[33] as twice_median, round(list_stddev_pop(v), 6) as std, list_min(list_filter(list_distinct(w), lambda u: len(list_filter(w, lambda x: x = u)) = list_max(list_transform(w, lambda t: len(list_filter(w, lambda x: x = t)))))) as mode, cast(len(list_distinct(w)) as int) as kinds,
cast(len(list_filter(v, lambda x: x < -0.1)) as int) as before, list_indexof(v, list_min(v)) - 1 as first, round(list_sum(list_transform(v, lambda x: least(greatest(x, -0.1), 0.1))), 5) as clipped, round(list_sum(list_transform(range(64), lambda i: greatest(v[i + 1], v[64 - i]))), 5) as larger, round(list_sum(list_transform(range(64), lambda i: case when w[i + 1] <> 0 then v[i + 1] else v[64 - i] end)), 5) as chosen, cast(len(list_filter(w, lambda x: x in (0, 1))) as int) as among, v[1] > 0 and v[1] < 1 and v[2] > 0 and v[2] < 1 as inside from e""")
def array_functions(s, d):
    """Medians, modes, deviations, orders, choices and tests of array columns."""
    v, w = F.col("v"), F.col("w")
    x = vectors(s, d).withColumn("w", F.transform("v", lambda x: F.floor(x * 10).cast("int")))
    out = x.select(
        "vec_id",
        (U.median(v) * 2).alias("twice_median"),
        F.round(U.std(v), 6).alias("std"),
        U.mode(w).alias("mode"),
        F.size(U.unique(w)).alias("kinds"),
        U.searchsorted(F.array_sort(v), F.array(F.lit(-0.1)))[0].alias("before"),
        U.argsort(v)[0].cast("int").alias("first"),
        F.round(A.total(U.clip(v, -0.1, 0.1)), 5).alias("clipped"),
        F.round(A.total(U.maximum(v, F.reverse(v))), 5).alias("larger"),
        F.round(A.total(U.where(w, v, F.reverse(v))), 5).alias("chosen"),
        F.size(F.filter(U.in1d(w, F.array(F.lit(0), F.lit(1))), lambda c: c)).alias("among"),
        U.in_bounds(F.slice(v, F.lit(1), F.lit(2)), F.array(F.lit(1e-12), F.lit(1e-12)), F.array(F.lit(1.0), F.lit(1.0))).alias("inside"),
    )
    return out


@query(_F + """, r as (select vec_id, (list_max(v) - list_min(v)) as top, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v))) as y, label from e) select vec_id, round(list_sum(y), 5) as scaled, cast(list_sum(list_transform(y, lambda x: cast(floor(x * 255) as bigint))) as bigint) as integers, cast(len(list_filter(range(64), lambda i: y[i + 1] > 0.5 and i // 8 % 2 = 1)) as int) as odd_rows from r""")
def array_rescaling(s, d):
    """Values to [0, 1] and to whole numbers, and cells in an order that turns at each row's end."""
    x = vectors(s, d).withColumn("y", U.rescale_each(F.array(F.col("v")))[0])
    turned = U.reorder(F.col("y"), U.scan_order(8, 8, "s_curve"))
    odd = F.filter(F.transform(turned, lambda v, i: F.when((v > 0.5) & (F.floor(i / 8) % 2 == 1), i)), lambda i: i.isNotNull())
    whole = U.rescale_to_integers(F.col("v"), 8)
    return x.select("vec_id", F.round(A.total(F.col("y")), 5).alias("scaled"), F.aggregate(whole, F.lit(0).cast("long"), lambda a, b: a + b).alias("integers"), F.size(odd).alias("odd_rows"))


@query(_F + ", p as (select vec_id, label, (v[1] + v[2] * 2) / 2 > 0.05 as pred from e), m as (select abs(cast(pred as int) - cast(label > 4 as int)) as error, case when label > 4 then cast(pred as int) end as recall from p) select 'error' as metric, round(avg(error), 6) as mean, cast(min(error) as double) as min, cast(max(error) as double) as max, count(error) as n from m union all select 'recall', round(avg(recall), 6), min(recall), max(recall), count(recall) from m")
def evaluation(s, d):
    """An ensemble of two predictions, thresholded, against labels; records without a positive label have no recall."""
    e = Evaluator(
        "vec_id",
        {"a": lambda: F.col("v")[0], "b": lambda: F.col("v")[1] * 2},
        {"error": lambda p: F.abs(p - F.col("y")), "recall": lambda p: F.when(F.col("y") == 1, p)},
        prepare={"y": (F.col("label") > 4).cast("int")},
        post=[lambda p: (p > 0.05).cast("int")],
    )
    x = e.summary(vectors(s, d))
    return x.select("metric", F.round("mean", 6).alias("mean"), "min", "max", "n")
