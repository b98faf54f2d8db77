"""Queries of boxes, patches, arrays, signals, distances and relational extensions."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.functions import arrays as A
from stratalens.functions import signals as S
from stratalens.operators import boxes as B
from stratalens.operators import metrics as M
from stratalens.operators import patches as PT
from stratalens.plans.registry import query
from stratalens.session import read_table as t


def r6(c):
    return F.round(c, 6)


def boxes(s, d):
    """A box for each order line, grouped by order: corners from quantity, price, discount and tax."""
    x = t(s, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return x.select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("box_id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), (F.col("l_discount") + F.col("l_tax") / 10).alias("score"), q.alias("xmin"), p.alias("ymin"), (q + F.col("l_discount") * 200 + 1).alias("xmax"), (p + F.col("l_tax") * 200 + 1).alias("ymax"))


BOXES = "with b as (select l_orderkey as image_id, l_linenumber * 1000000 + l_partkey as box_id, case when l_returnflag = 'R' then 1 else 0 end as label, l_discount + l_tax / 10 as score, l_quantity as xmin, l_extendedprice / 1000 as ymin, l_quantity + l_discount * 200 + 1 as xmax, l_extendedprice / 1000 + l_tax * 200 + 1 as ymax from lineitem) "
PAIRS = BOXES + ", p as (select a.image_id, a.box_id as a_box, c.box_id as b_box, greatest(least(a.xmax, c.xmax) - greatest(a.xmin, c.xmin), 0) * greatest(least(a.ymax, c.ymax) - greatest(a.ymin, c.ymin), 0) as i, (a.xmax - a.xmin) * (a.ymax - a.ymin) as aa, (c.xmax - c.xmin) * (c.ymax - c.ymin) as ba, (greatest(a.xmax, c.xmax) - least(a.xmin, c.xmin)) * (greatest(a.ymax, c.ymax) - least(a.ymin, c.ymin)) as hull, sqrt(pow((a.xmin + a.xmax - c.xmin - c.xmax) / 2, 2) + pow((a.ymin + a.ymax - c.ymin - c.ymax) / 2, 2)) as dist from b a join b c on a.image_id = c.image_id and a.box_id < c.box_id and a.xmin <= c.xmax and c.xmin <= a.xmax and a.ymin <= c.ymax and c.ymin <= a.ymax) "


@query(PAIRS + "select image_id, a_box, b_box, round(i / (aa + ba - i + 1.1920929e-07), 5) as iou, round(i / (aa + ba - i + 1.1920929e-07) - (hull - (aa + ba - i)) / (hull + 1.1920929e-07), 5) as giou, round(dist, 5) as center_distance from p")
def box_iou_pairs(s, d):
    b = boxes(s, d)
    side = lambda p: b.select("image_id", *[F.col(c).alias(p + c) for c in ("box_id", "xmin", "ymin", "xmax", "ymax")])
    x = B.overlap_join(side("a_"), side("b_"), "a_", "b_", "xy", 32.0, on=["image_id"]).where("a_box_id < b_box_id")
    return x.select("image_id", F.col("a_box_id").alias("a_box"), F.col("b_box_id").alias("b_box"), F.round(B.box_iou("a_", "b_"), 5).alias("iou"), F.round(B.box_giou("a_", "b_"), 5).alias("giou"), F.round(B.center_distance("a_", "b_"), 5).alias("center_distance"))


@query(BOXES + "select a.image_id, a.box_id as point_id, c.box_id from b a join b c on a.image_id = c.image_id and a.box_id <> c.box_id and (a.xmin + a.xmax) / 2 > c.xmin + 0.01 and (a.xmin + a.xmax) / 2 < c.xmax - 0.01 and (a.ymin + a.ymax) / 2 > c.ymin + 0.01 and (a.ymin + a.ymax) / 2 < c.ymax - 0.01")
def centers_in_boxes(s, d):
    b = boxes(s, d)
    points = b.select("image_id", F.col("box_id").alias("point_id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    x = B.centers_in_boxes(points, b.select("image_id", "box_id", "xmin", "ymin", "xmax", "ymax"), "xy", 32.0, on=["image_id"])
    return x.where("point_id <> box_id").select("image_id", "point_id", "box_id")


@query(BOXES + "select box_id, image_id, round((xmax - xmin) * (ymax - ymin), 5) as area, round(least(greatest(xmax, 0), 40), 6) as clipped_xmax, round((xmin + xmax) / 2, 6) as xcenter from b")
def box_area_clip(s, d):
    b = boxes(s, d)
    return b.select("box_id", "image_id", F.round(B.area(), 5).alias("area"), r6(B.clip("xy", {"x": 40, "y": 40})["xmax"]).alias("clipped_xmax"), r6((F.col("xmin") + F.col("xmax")) / 2).alias("xcenter"))


@query("with recursive " + BOXES[5:] + ", r as (select *, row_number() over (partition by image_id order by score desc, box_id) as k from b), o as (select c.image_id, c.k, list(a.k) as before from r a join r c on a.image_id = c.image_id and a.k < c.k and {i} / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (c.xmax - c.xmin) * (c.ymax - c.ymin) - {i} + 1.1920929e-07) > 0.3 group by all), x as (select r.image_id, r.k, coalesce(before, []) as before from r left join o using (image_id, k)), g(image_id, k, kept) as (select image_id, k, [k] from x where k = 1 union all select x.image_id, x.k, case when list_has_any(g.kept, x.before) then g.kept else list_append(g.kept, x.k) end from g join x on g.image_id = x.image_id and x.k = g.k + 1) select r.image_id, r.box_id, round(score, 6) as score from g join r using (image_id, k) where list_contains(g.kept, r.k)".replace("{i}", "(greatest(least(a.xmax, c.xmax) - greatest(a.xmin, c.xmin), 0) * greatest(least(a.ymax, c.ymax) - greatest(a.ymin, c.ymin), 0))"))
def box_nms(s, d):
    return B.nms(boxes(s, d), ["image_id"], ["xmin", "ymin", "xmax", "ymax"], "score", "box_id", 0.3).select("image_id", "box_id", r6("score").alias("score"))


@query("with recursive " + BOXES[5:] + ", r as (select *, row_number() over (partition by image_id, label order by score desc, box_id) as k from b), o as (select c.image_id, c.label, c.k, list(a.k) as before from r a join r c on a.image_id = c.image_id and a.label = c.label and a.k < c.k and {i} / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (c.xmax - c.xmin) * (c.ymax - c.ymin) - {i} + 1.1920929e-07) > 0.3 group by all), x as (select r.image_id, r.label, r.k, coalesce(before, []) as before from r left join o using (image_id, label, k)), g(image_id, label, k, kept) as (select image_id, label, k, [k] from x where k = 1 union all select x.image_id, x.label, x.k, case when list_has_any(g.kept, x.before) then g.kept else list_append(g.kept, x.k) end from g join x on g.image_id = x.image_id and g.label = x.label and x.k = g.k + 1) select r.image_id, r.label, r.box_id, round(score, 6) as score from g join r using (image_id, label, k) where list_contains(g.kept, r.k)".replace("{i}", "(greatest(least(a.xmax, c.xmax) - greatest(a.xmin, c.xmin), 0) * greatest(least(a.ymax, c.ymax) - greatest(a.ymin, c.ymin), 0))"))
def batched_nms(s, d):
    return B.nms(boxes(s, d), ["image_id", "label"], ["xmin", "ymin", "xmax", "ymax"], "score", "box_id", 0.3).select("image_id", "label", "box_id", r6("score").alias("score"))


_INTER = "(greatest(least(p.xmax, q.xmax) - greatest(p.xmin, q.xmin), 0) * greatest(least(p.ymax, q.ymax) - greatest(p.ymin, q.ymin), 0))"
_COCO = ("with recursive " + BOXES[5:] + """, p as (select *, row_number() over (partition by image_id, label order by score desc, box_id) as k from b qualify k <= 100), q as (select *, row_number() over (partition by image_id, label order by box_id, xmin, ymin) as j from b where label = 1 or score > 0.05), n as (select label, count(*) as n from q group by 1), h as (select unnest([0.1, 0.3, 0.5])::double as iou),
c as (select p.image_id, p.label, p.k, p.box_id, h.iou, list({'v': v, 'j': q.j} order by v desc, q.j desc) as cand from p join q using (image_id, label), h, lateral (select {i} / ((p.xmax - p.xmin) * (p.ymax - p.ymin) + (q.xmax - q.xmin) * (q.ymax - q.ymin) - {i} + 1.1920929e-07) as v) where v >= h.iou group by all),
x as (select p.image_id, p.label, p.k, p.score, h.iou, coalesce(list_transform(cand, lambda s: s.j), []) as cand from p cross join h left join c on c.image_id = p.image_id and c.label = p.label and c.k = p.k and c.iou = h.iou),
g(image_id, label, iou, k, score, used, hit) as (select image_id, label, iou, k, score, case when len(cand) > 0 then [cand[1]] else [] end, len(cand) > 0 from x where k = 1
union all select x.image_id, x.label, x.iou, x.k, x.score, case when len(list_filter(x.cand, lambda j: not list_contains(g.used, j))) > 0 then list_append(g.used, list_filter(x.cand, lambda j: not list_contains(g.used, j))[1]) else g.used end, len(list_filter(x.cand, lambda j: not list_contains(g.used, j))) > 0 from g join x on x.image_id = g.image_id and x.label = g.label and x.iou = g.iou and x.k = g.k + 1),
e as (select label, iou, score, sum(cast(hit as int)) as tp, count(*) as c from g group by 1, 2, 3), r as (select label, iou, sum(tp) over w as tp, sum(c) over w as c from e window w as (partition by label, iou order by score desc)),
s as (select label, iou, floor(tp / n * 100 + 1e-9) as step, max(tp / c) as pr, max(tp / n) as ar from r join n using (label) group by 1, 2, 3), v as (select *, max(pr) over (partition by label, iou order by step desc) as envelope, coalesce(lead(step) over (partition by label, iou order by step desc), -1) as below from s)
select v.label, v.iou, round(sum(envelope * (step - below)) / 101, 6) as ap, round(max(ar), 6) as ar, round((select count(*) from g where g.label = v.label and g.iou = v.iou and hit and k <= 1) / max(n), 6) as ar_1, round((select count(*) from g where g.label = v.label and g.iou = v.iou and hit and k <= 2) / max(n), 6) as ar_2, max(n) as n_truth from v join n using (label) group by 1, 2""").replace("{i}", _INTER)


@query(_COCO)
def coco_ap(s, d):
    b = boxes(s, d)
    truth = b.where("label = 1 or score > 0.05").select("image_id", "label", "xmin", "ymin", "xmax", "ymax")
    x = B.coco_ap(b, truth, ["xmin", "ymin", "xmax", "ymax"], (0.1, 0.3, 0.5), recall_at=(1, 2))
    return x.select("label", "iou", *[r6(c).alias(c) for c in ("ap", "ar", "ar_1", "ar_2")], "n_truth")


_AREAS = {"all": (0.0, 1e10), "small": (0.0, 150.0), "large": (150.0, 1e10)}
_COCO_AREAS = ("with recursive " + BOXES[5:] + """, p as (select *, (xmax - xmin) * (ymax - ymin) as size, row_number() over (partition by image_id, label order by score desc, box_id) as k from b qualify k <= 100), q as (select *, (xmax - xmin) * (ymax - ymin) as size, box_id % 5 = 0 as ignore, row_number() over (partition by image_id, label order by box_id, xmin, ymin) as j from b where label = 1 or score > 0.05),
h as (select * from (values (0.1::double), (0.3)) as i(iou), (values {areas}) as a(area, lo, hi)), n as (select label, area, count(*) filter (where not ignore and size between lo and hi) as n from q, (select distinct area, lo, hi from h) group by all),
c as (select p.image_id, p.label, p.k, h.iou, h.area, list({'j': q.j, 'code': 1 + cast(ig as int)} order by ig, v desc, q.j desc) as cand from p join q using (image_id, label), h, lateral (select {i} / (p.size + q.size - {i} + 1.1920929e-07) as v, q.ignore or q.size < h.lo or q.size > h.hi as ig) where v >= h.iou group by all),
x as (select p.image_id, p.label, p.k, p.score, h.iou, h.area, case when p.size < h.lo or p.size > h.hi then 2 else 0 end as miss, coalesce(cand, []) as cand from p cross join h left join c on c.image_id = p.image_id and c.label = p.label and c.k = p.k and c.iou = h.iou and c.area = h.area),
g(image_id, label, iou, area, k, score, used, hit) as (select image_id, label, iou, area, k, score, case when len(cand) > 0 then [cand[1].j] else [] end, case when len(cand) > 0 then cand[1].code else miss end from x where k = 1
union all select image_id, label, iou, area, k, score, case when len(free) > 0 then list_append(used, free[1].j) else used end, case when len(free) > 0 then free[1].code else miss end from (select x.*, g.used, list_filter(x.cand, lambda s: not list_contains(g.used, s.j)) as free from g join x on x.image_id = g.image_id and x.label = g.label and x.iou = g.iou and x.area = g.area and x.k = g.k + 1)),
e as (select label, iou, area, score, sum(cast(hit = 1 as int)) as tp, sum(cast(hit < 2 as int)) as c from g group by all), r as (select label, iou, area, sum(tp) over w as tp, sum(c) over w as c from e window w as (partition by label, iou, area order by score desc)),
s as (select label, iou, area, floor(tp / n * 100 + 1e-9) as step, max(tp / c) as pr, max(tp / n) as ar from r join n using (label, area) where c > 0 and n > 0 group by 1, 2, 3, 4), v as (select *, max(pr) over (partition by label, iou, area order by step desc) as envelope, coalesce(lead(step) over (partition by label, iou, area order by step desc), -1) as below from s),
a as (select label, iou, area, sum(envelope * (step - below)) / 101 as ap, max(ar) as ar from v group by all)
select d.label, d.iou, d.area, round(case when coalesce(n, 0) = 0 then -1 else coalesce(ap, 0) end, 6) as ap, round(case when coalesce(n, 0) = 0 then -1 else coalesce(ar, 0) end, 6) as ar, coalesce(n, 0) as n_truth from (select distinct label, iou, area from g) d left join a using (label, iou, area) left join n using (label, area)""").replace("{i}", _INTER).replace("{areas}", ", ".join(f"('{k}', {lo}::double, {hi}::double)" for k, (lo, hi) in _AREAS.items()))


@query(_COCO_AREAS)
def coco_ap_areas(s, d):
    """Precision and recall for all, small and large boxes, with every fifth truth ignored."""
    b = boxes(s, d)
    truth = b.where("label = 1 or score > 0.05").select("image_id", "label", "xmin", "ymin", "xmax", "ymax", (F.col("box_id") % 5 == 0).alias("ignore"))
    x = B.coco_ap(b, truth, ["xmin", "ymin", "xmax", "ymax"], (0.1, 0.3), areas=_AREAS)
    return x.select("label", "iou", "area", r6("ap").alias("ap"), r6("ar").alias("ar"), "n_truth")


@query(BOXES + ", r as (select *, row_number() over (partition by image_id order by score desc, box_id) k from b) select image_id, box_id, cast(k as int) as rank from r where k <= 2")
def box_selector_topk(s, d):
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "box_id")
    return boxes(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("image_id", "box_id", "rank")


_E = "with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) "


def vectors(s, d):
    return t(s, d, "embeddings").select("vec_id", "label", A.as_doubles(F.col("embedding")).alias("v"))


def single(x: float) -> float:
    """A threshold in the precision of the stored values, 32 bits: SQL compares them so."""
    return struct.unpack("f", struct.pack("f", x))[0]


def patches(s, d):
    return PT.split(vectors(s, d), "v", 16, 0.5)


@query(_E + "select vec_id, cast(st as int) as start, round(list_sum(v[st + 1 : st + 16]), 6) as total from e, unnest(generate_series(0, 48, 8)) as u(st)")
def patch_grid(s, d):
    return patches(s, d).select("vec_id", "start", r6(A.total(F.col("patch"))).alias("total"))


@query(_E + "select vec_id, cast(i as int) as position, round(v[i + 1], 6) as value from e, unnest(generate_series(0, 63)) as u(i)")
def patch_merge_avg(s, d):
    return PT.merge(patches(s, d), ["vec_id"]).select("vec_id", "position", r6("value").alias("value"))


@query(_E + """, w as (select st, i, exp(-pow(i - 7.5, 2) / 8.0) / exp(-0.03125) as w from unnest(generate_series(0, 48, 8)) as a(st), unnest(generate_series(0, 15)) as b(i))
select vec_id, cast(st + i as int) as position, round(sum(w * v[st + i + 1] * (st + 1)) / sum(w), 4) as value from e, w group by 1, 2""")
def sliding_window_gaussian(s, d):
    p = patches(s, d).withColumn("patch", F.transform("patch", lambda x: x * (F.col("start") + 1)))
    return PT.merge(p, ["vec_id"], PT.gaussian_weights(16)).select("vec_id", "position", F.round("value", 4).alias("value"))


@query(_E + ", p as (select vec_id, st, list_sum(v[st + 1 : st + 16]) as total from e, unnest(generate_series(0, 48, 8)) as u(st)), r as (select *, row_number() over (partition by vec_id order by total desc, st) k from p where total < 1.0) select vec_id, cast(st as int) as start, round(total, 6) as total, cast(k as int) as rank from r where k <= 3")
def grid_patch_topk(s, d):
    p = patches(s, d).withColumn("total", A.total(F.col("patch"))).where("total < 1.0")
    return PT.top_patches(p, ["vec_id"], 3, F.col("total")).select("vec_id", "start", r6("total").alias("total"), "rank")


@query(_E + "select vec_id, list_position(v, list_max(v)) - 1 as argmax, round(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) as z, round(exp(v[1] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 9) as p0, round(1 / (1 + exp(-v[1])), 6) as s0, cast(label = 3 as int) as hot3, cast(len(list_filter(v, lambda x: x >= 0.1)) as int) as above from e")
def activations(s, d):
    v = F.col("v")
    z = A.total(F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return vectors(s, d).select("vec_id", A.argmax(v).alias("argmax"), r6(z).alias("z"), F.round(A.softmax(v)[0], 9).alias("p0"), r6(A.sigmoid(v)[0]).alias("s0"), A.one_hot(F.col("label"), 10)[3].alias("hot3"), F.aggregate(A.threshold(v, 0.1), F.lit(0), lambda a, b: a + b).alias("above"))


_FG = ", f as (select vec_id, list_filter(range(0, 64), lambda i: v[i + 1] > 0.2) as ix, v from e) "


@query(_E + _FG + "select vec_id, cast(coalesce(list_min(ix), 0) as int) as start, cast(coalesce(list_max(ix) + 1, 0) as int) as stop, round(list_sum(v[coalesce(list_min(ix), 0) + 1 : coalesce(list_max(ix) + 1, 0)]), 6) as total from f")
def crop_foreground(s, d):
    x = vectors(s, d).withColumn("b", A.foreground_box(F.col("v"), 0.2))
    cut = F.slice("v", F.col("b.start") + 1, F.col("b.end") - F.col("b.start"))
    total = F.when(F.size(cut) > 0, A.total(cut))
    return x.select("vec_id", F.col("b.start").alias("start"), F.col("b.end").alias("stop"), r6(total).alias("total"))


@query(_E + "select vec_id, round(v[17], 6) as crop0, round(v[64], 6) as flip0, round(v[25], 6) as center0, cast(0.0 as double) as pad0, round(v[1], 6) as pad3, cast(70 as int) as size, round(v[62], 6) as roll0 from e")
def array_pad_crop_flip(s, d):
    v = F.col("v")
    padded = A.pad_to(v, 70)
    return vectors(s, d).select("vec_id", r6(A.crop(v, 16, 32)[0]).alias("crop0"), r6(A.flip(v)[0]).alias("flip0"), r6(A.center_crop(v, 16)[0]).alias("center0"), padded[0].alias("pad0"), r6(padded[3]).alias("pad3"), F.size(padded).alias("size"), r6(A.roll(v, 3)[0]).alias("roll0"))


@query(_E + "select vec_id, cast(len(list_filter(v, lambda x: x > 0)) as int) as n_fg, list_sum(list_filter(range(0, 64), lambda i: v[i + 1] > 0))::bigint as fg_sum, list_sum(list_filter(range(0, 64), lambda i: not v[i + 1] > 0))::bigint as bg_sum from e")
def fg_bg_indices(s, d):
    v = F.col("v")
    fg, bg = A.foreground(v), F.filter(F.transform(v, lambda x, i: F.when(~(x > 0), i)), lambda i: i.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return vectors(s, d).select("vec_id", F.size(fg).alias("n_fg"), add(fg).alias("fg_sum"), add(bg).alias("bg_sum"))


@query(_E + "select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as norm, round(list_sum(v) / 64, 6) as mean, round(list_sum(v[1:10]), 6) as c9 from e")
def array_stats(s, d):
    v = F.col("v")
    return vectors(s, d).select("vec_id", r6(A.norm2(v)).alias("norm"), r6(A.mean(v)).alias("mean"), r6(A.cumsum(v)[9]).alias("c9"))


_ORD = "partition by user_id order by ts, event_id"


@query(f"select event_id, round(avg(value) over ({_ORD} rows between 2 preceding and 2 following), 6) as value from events")
def moving_average(s, d):
    return S.moving_average(t(s, d, "events"), "value", ["user_id"], ["ts", "event_id"], 2, "m").select("event_id", r6("m").alias("value"))


@query(f"select event_id, round(median(value) over ({_ORD} rows between 1 preceding and 1 following), 6) as value from events")
def median_smooth(s, d):
    return S.median_smooth(t(s, d, "events"), "value", ["user_id"], ["ts", "event_id"], 1, "m").select("event_id", r6("m").alias("value"))


_SG = "round((-3 * {a} + 12 * {b} + 17 * value + 12 * {c} - 3 * {d}) / 35, 5)"
_FROM = "with e as (select *, row_number() over w as i, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts, event_id)) "
_AT = "(select value from e x where x.user_id = e.user_id and x.i = {k})"


@query(f"select event_id, {_SG.format(**{k: f'coalesce({f}(value, {n}) over ({_ORD}), 0)' for k, f, n in (('a', 'lag', 2), ('b', 'lag', 1), ('c', 'lead', 1), ('d', 'lead', 2))})} as value from events")
def savgol(s, d):
    """Zeros beyond the ends, as is the default."""
    return S.convolve(t(s, d, "events"), "value", ["user_id"], ["ts", "event_id"], S.savitzky_golay(2, 2), "m").select("event_id", F.round("m", 5).alias("value"))


def _mode(rule: str) -> str:
    at = {k: f"(select x.value from e x where x.user_id = e.user_id and x.i = {rule.format(j=f'(e.i + {o})')})" for k, o in (("a", -2), ("b", -1), ("c", 1), ("d", 2))}
    return _SG.format(**at).replace("value +", "e.value +")


@query(_FROM + f"select event_id, {_mode('least(greatest({j}, 1), e.n)')} as replicated, {_mode('case when {j} < 1 then 2 - {j} when {j} > e.n then 2 * e.n - {j} else {j} end')} as reflected, {_mode('case when {j} < 1 then {j} + e.n when {j} > e.n then {j} - e.n else {j} end')} as circular from e where n >= 3")
def savgol_edges(s, d):
    x, made = t(s, d, "events"), []
    for mode, name in (("replicate", "replicated"), ("reflect", "reflected"), ("circular", "circular")):
        x = S.convolve(x, "value", ["user_id"], ["ts", "event_id"], S.savitzky_golay(2, 2), name, mode)
        made.append(F.round(name, 5).alias(name))
    n = F.count("*").over(Window.partitionBy("user_id"))
    return x.withColumn("n", n).where("n >= 3").select("event_id", *made)


@query(f"select event_id, round(coalesce(lag(value, 2) over ({_ORD}), 0), 6) as shifted, round(value * 1.5, 6) as scaled, round(case when isnan(value) then 0 else value end, 6) as filled from events")
def signal_shift_scale_fill(s, d):
    x = S.shift(t(s, d, "events"), "value", ["user_id"], ["ts", "event_id"], 2, "m")
    return x.select("event_id", r6("m").alias("shifted"), r6(F.col("value") * 1.5).alias("scaled"), r6(S.fill_empty(F.col("value"))).alias("filled"))


@query("""with b as (select user_id, event_id, ts, cast(value > 50 as int) v from events)
select event_id, min(v) over w as eroded, max(v) over w as dilated, max(v) over w - min(v) over w as contour from b window w as (partition by user_id order by ts, event_id rows between 1 preceding and 1 following)""")
def morphology(s, d):
    x = t(s, d, "events").select("user_id", "event_id", "ts", (F.col("value") > 50).cast("int").alias("v"))
    x = S.dilate(S.erode(x, "v", ["user_id"], ["ts", "event_id"], 1, "eroded"), "v", ["user_id"], ["ts", "event_id"], 1, "dilated")
    return x.select("event_id", "eroded", "dilated", (F.col("dilated") - F.col("eroded")).alias("contour"))


def _edges(s, d):
    e = t(s, d, "events").select("user_id", "event_id", "event_type")
    return e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'click'").select("user_id", "event_id")


_DIST = "with p as (select user_id, event_id from events where event_type = 'view'), q as (select user_id, event_id from events where event_type = 'click'), ab as (select p.user_id, p.event_id, min(abs(p.event_id - q.event_id)) dist from p join q using (user_id) group by 1, 2), ba as (select q.user_id, q.event_id, min(abs(p.event_id - q.event_id)) dist from p join q using (user_id) group by 1, 2) "


@query(_DIST + "select user_id, cast(greatest(max(a), max(b)) as bigint) as hausdorff, round((sum(sa) + sum(sb)) / (sum(na) + sum(nb)), 6) as average, round((sum(ta) + sum(tb)) / (sum(na) + sum(nb)), 6) as surface_dice from (select user_id, max(dist) a, null b, sum(dist) sa, 0 sb, count(*) na, 0 nb, sum(cast(dist <= 50 as int)) ta, 0 tb from ab group by 1 union all select user_id, null, max(dist), 0, sum(dist), 0, count(*), 0, sum(cast(dist <= 50 as int)) from ba group by 1) group by 1")
def surface_distances(s, d):
    a, b = _edges(s, d)
    x = M.nearest_distance(a, b, ["user_id"], "event_id").unionByName(M.nearest_distance(b, a, ["user_id"], "event_id")).where("distance is not null")
    return x.groupBy("user_id").agg(F.max("distance").alias("hausdorff"), r6(F.avg("distance")).alias("average"), r6(F.avg((F.col("distance") <= 50).cast("double"))).alias("surface_dice"))


@query("select o_orderstatus, o_orderpriority, cast(grouping_id(o_orderstatus, o_orderpriority) as bigint) as gid, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def cube_totals(s, d):
    x = t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return x.select("o_orderstatus", "o_orderpriority", "gid", "n", "total")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_counts(s, d):
    return t(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("(select doc_id from documents intersect select doc_id from labels) except (select doc_id from labels where toxic = 1)")
def intersect_except(s, d):
    labels = t(s, d, "labels")
    return t(s, d, "documents").select("doc_id").intersect(labels.select("doc_id")).exceptAll(labels.where("toxic = 1").select("doc_id"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join(s, d):
    return t(s, d, "documents").select("doc_id", "source").join(t(s, d, "labels").where("quality = 1"), "doc_id", "left_semi")
