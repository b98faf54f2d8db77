"""Queries of box transforms, codes, anchors and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.operators import detection as DT
from stratalens.plans.catalogue_arrays import BOXES, boxes
from stratalens.plans.registry import query

SIDES = ("xmin", "ymin", "xmax", "ymax")


def r5(c):
    return F.round(c, 5)


def unit_sql(key: str, seed: str) -> str:
    return f"(cast(('0x' || substr(md5(concat('{seed}:', {key})), 1, 8)) as bigint) / 4294967296.0::double)"


def _sides(df, *more):
    return df.select("box_id", "image_id", *[r5(c).alias(c) for c in SIDES], *more)


_ALL = ", ".join(f"round({c}, 5) as {c}" for c in SIDES)


@query(BOXES + f", z as (select box_id, image_id, xmin * 1.0471975511965976::double as xmin, ymin * 0.4142135623730951::double as ymin, xmax * 1.0471975511965976::double as xmax, ymax * 0.4142135623730951::double as ymax from b) select box_id, image_id, {_ALL} from z")
def box_zoom(s, d):
    return _sides(boxes(s, d).withColumns(DT.zoom([1.0471975511965976, 0.4142135623730951])))


@query(BOXES + f", z as (select box_id, image_id, xmin * (173.20508075688772::double / 100) as xmin, ymin * (141.4213562373095::double / 400) as ymin, xmax * (173.20508075688772::double / 100) as xmax, ymax * (141.4213562373095::double / 400) as ymax from b) select box_id, image_id, {_ALL} from z")
def box_resize(s, d):
    return _sides(boxes(s, d).withColumns(DT.resize([100, 400], [173.20508075688772, 141.4213562373095])))


@query(BOXES + f", z as (select box_id, image_id, 200 - xmax as xmin, ymin, 200 - xmin as xmax, ymax from b) select box_id, image_id, {_ALL} from z")
def box_flip(s, d):
    return _sides(boxes(s, d).withColumns(DT.flip([200, 300], "x")))


@query(BOXES + """, z as (select box_id, image_id, 1 as k, 300 - ymax as xmin, xmin as ymin, 300 - ymin as xmax, xmax as ymax from b union all select box_id, image_id, 2, 200 - xmax, 300 - ymax, 200 - xmin, 300 - ymin from b union all select box_id, image_id, 3, ymin, 200 - xmax, ymax, 200 - xmin from b)
select box_id, image_id, round(xmin, 5) as xmin, round(ymin, 5) as ymin, round(xmax, 5) as xmax, round(ymax, 5) as ymax, k from z""")
def box_rotate90(s, d):
    b = boxes(s, d)
    out = None
    for k in (1, 2, 3):
        x = _sides(b.withColumns(DT.rotate90([200, 300], k)), F.lit(k).alias("k"))
        out = x if out is None else out.unionByName(x)
    return out


@query(BOXES + f", z as (select box_id, image_id, least(0.5 * xmin - 2 * ymin + 3, 0.5 * xmax - 2 * ymax + 3) as xmin, least(xmin + ymin - 1, xmax + ymax - 1) as ymin, greatest(0.5 * xmin - 2 * ymin + 3, 0.5 * xmax - 2 * ymax + 3) as xmax, greatest(xmin + ymin - 1, xmax + ymax - 1) as ymax from b) select box_id, image_id, {_ALL} from z")
def box_affine(s, d):
    return _sides(boxes(s, d).withColumns(DT.affine([[0.5, -2, 3], [1, 1, -1], [0, 0, 1]])))


@query(BOXES + f"select box_id, image_id, {_ALL} from b")
def box_world_and_back(s, d):
    """To world coordinates and back again (an axis-aligned affine)."""
    m = [[2.0, 0, 5], [0, -0.5, 7], [0, 0, 1]]
    return _sides(boxes(s, d).withColumns(DT.affine(m)).withColumns(DT.inverse_affine(m)))


@query(BOXES + f", z as (select box_id, image_id, least(greatest(xmin, 10), 40) - 10 as xmin, least(greatest(ymin, 5), 60) - 5 as ymin, least(greatest(xmax, 10), 40) - 10 as xmax, least(greatest(ymax, 5), 60) - 5 as ymax from b) select box_id, image_id, {_ALL} from z where xmax >= xmin + 1 and ymax >= ymin + 1")
def box_crop(s, d):
    return _sides(DT.crop(boxes(s, d), [10, 5], [40, 60]))


@query(BOXES + """select box_id, round(xmin, 5) as t0, round(xmax, 5) as t1, round(xmax - xmin, 5) as w, round((ymin + ymax) / 2, 5) as cy, xmax >= xmin and ymax >= ymin as valid, round(xmin, 5) as back from b""")
def box_layouts(s, d):
    """Corner, corner-size and centre-size layouts and back."""
    x = boxes(s, d).withColumn("b", DT.to_layout("xxyy"))
    x = DT.convert_layout(F.col("b"), "xxyy", "xywh", x, "c")
    x = DT.convert_layout(F.col("c"), "xywh", "ccwh", x, "e")
    back = DT.from_layout(F.col("e"), "ccwh")["xmin"]
    return x.select("box_id", r5(F.col("b")[0]).alias("t0"), r5(F.col("b")[1]).alias("t1"), r5(F.col("c")[2]).alias("w"), r5(F.col("e")[1]).alias("cy"), DT.is_valid().alias("valid"), r5(back).alias("back"))


_DRAWN = f"case when {unit_sql('image_id', '4p')} < 0.5 then "


@query(BOXES + f", z as (select box_id, image_id, {_DRAWN}{unit_sql('image_id', '4')} * (1.5 - 0.5) + 0.5 else 1.0 end as z, {unit_sql('image_id', '6p')} < 0.5 as f, xmin, xmax, ymin, ymax from b) select box_id, round(xmin * z, 5) as zoomed, round(case when f then 200 - xmax else xmin end, 5) as flipped from z")
def box_random_zoom_flip(s, d):
    b = boxes(s, d).withColumn("own", F.struct(*SIDES))
    z = DT.rand_zoom(b, "image_id", 0.5, 1.5, 0.5, 4).withColumn("zoomed", r5("xmin")).withColumns({c: F.col(f"own.{c}") for c in SIDES})
    return DT.rand_flip(z, "image_id", [200, 300], "x", 0.5, 6).select("box_id", "zoomed", r5("xmin").alias("flipped"))


@query(BOXES + f", z as (select *, case when {unit_sql('image_id', '8p')} < 0.7 then cast(floor({unit_sql('image_id', '8')} * 3) as int) + 1 else 0 end as k from b) select box_id, image_id, round(case k when 0 then xmin when 1 then 300 - ymax when 2 then 200 - xmax else ymin end, 5) as xmin, round(case k when 0 then ymin when 1 then xmin when 2 then 300 - ymax else 200 - xmax end, 5) as ymin from z")
def box_random_rotate90(s, d):
    return DT.rand_rotate90(boxes(s, d), "image_id", [200, 300], 0.7, 3, 8).select("box_id", "image_id", r5("xmin").alias("xmin"), r5("ymin").alias("ymin"))


@query(BOXES + ", c as (select image_id, label, box_id, x, y from b, unnest(range(cast(floor(xmin) as int), cast(floor(xmax) as int))) as u(x), unnest(range(cast(floor(ymin) as int), cast(floor(ymax) as int))) as v(y)) select image_id, label, count(*) as cells, cast(min(x) as int) as xmin, cast(max(x) + 1 as int) as xmax, cast(min(y) as int) as ymin, cast(max(y) + 1 as int) as ymax from (select distinct image_id, label, x, y from c) group by 1, 2")
def box_mask_box(s, d):
    """Masks of the boxes of a label, as cells, and the box around each mask."""
    x = DT.masks_of_boxes(boxes(s, d), ["image_id", "label"])
    return x.select("image_id", "label", "cells", "xmin", "xmax", "ymin", "ymax")


_CODE = BOXES + ", p as (select a.box_id, a.image_id, a.xmin, a.ymin, a.xmax, a.ymax, c.xmin x0, c.ymin y0, c.xmax x1, c.ymax y1 from b a join (select image_id, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax from b group by 1) c using (image_id)) "


@query(_CODE + "select box_id, image_id, round(10 * ((xmin + xmax) / 2 - (x0 + x1) / 2) / (x1 - x0), 5) as dx, round(5 * ln((ymax - ymin) / (y1 - y0)), 5) as dh, round(xmin, 5) as back from p")
def box_encode_decode(s, d):
    """Codes of boxes against the hull of their image's boxes, and what they decode to."""
    b = boxes(s, d)
    hull = b.groupBy("image_id").agg(*[(F.min if c.endswith("min") else F.max)(c).alias(f"r_{c}") for c in SIDES])
    w = (10.0, 10.0, 5.0, 5.0)
    x = b.join(hull, "image_id").withColumn("code", DT.encode("", "r_", weights=w))
    return x.select("box_id", "image_id", r5(F.col("code")[0]).alias("dx"), r5(F.col("code")[3]).alias("dh"), r5(DT.decode(F.col("code"), "r_", weights=w)["xmin"]).alias("back"))


GRIDS, STRIDES = [[8, 12], [4, 6]], [[16, 16], [32, 32]]
HALVES = [[(8.0, 8.0), (11.0, 6.0)], [(16.0, 16.0), (23.0, 11.0)]]
_ANCHORS = "a as (select 0 as level, i * 12 + j as place, i, j, 16.0::double as stride from range(8) t(i), range(12) u(j) union all select 1, i * 6 + j, i, j, 32.0 from range(4) t(i), range(6) u(j)), h(level, shape, hx, hy) as (values (0, 0, 8.0::double, 8.0::double), (0, 1, 11.0, 6.0), (1, 0, 16.0, 16.0), (1, 1, 23.0, 11.0)), n as (select level, place, shape, i * stride as ax, j * stride as ay, i * stride - hx as xmin, j * stride - hy as ymin, i * stride + hx as xmax, j * stride + hy as ymax from a join h using (level)) "


def shapes():
    """Half extents by size and ratio: 16 and 32 with ratios 1 and 0.5."""
    return [DT.anchor_shapes([n], [1.0, 0.5]) for n in (16, 32)]


@query(BOXES + ", " + _ANCHORS + ", e as (select image_id, max(xmax) as w, max(ymax) as h from b group by 1) select image_id, level, shape, count(*) as anchors, min(xmin) as xmin, min(ymin) as ymin, max(n.xmax) as xmax, max(n.ymax) as ymax from e join n on ax < w and ay < h group by 1, 2, 3")
def anchor_grid(s, d):
    """The anchors whose middle lies within an image's boxes: a few hundred of the plan against every image."""
    ends = boxes(s, d).groupBy("image_id").agg(F.max("xmax").alias("w"), F.max("ymax").alias("h"))
    anchors = F.broadcast(DT.anchors(s, GRIDS, STRIDES, shapes()).select("level", "shape", *SIDES))
    inside = ((F.col("xmin") + F.col("xmax")) / 2 < F.col("w")) & ((F.col("ymin") + F.col("ymax")) / 2 < F.col("h"))
    sides = [f(c).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))]
    return ends.join(anchors, inside).groupBy("image_id", "level", "shape").agg(F.count("*").alias("anchors"), *sides)


@query(BOXES + ", " + _ANCHORS + """, k as (select image_id, box_id, b.xmin, b.ymin, b.xmax, b.ymax, level, place, row_number() over (partition by image_id, box_id, level order by pow(ax - (b.xmin + b.xmax) / 2, 2) + pow(ay - (b.ymin + b.ymax) / 2, 2), place) r from b, (select distinct level, place, ax, ay from n)),
c as (select k.*, n.shape, n.ax, n.ay, greatest(least(k.xmax, n.xmax) - greatest(k.xmin, n.xmin), 0) * greatest(least(k.ymax, n.ymax) - greatest(k.ymin, n.ymin), 0) as i, (k.xmax - k.xmin) * (k.ymax - k.ymin) + (n.xmax - n.xmin) * (n.ymax - n.ymin) as total from k join n using (level, place) where r <= 4),
v as (select *, i / (total - i + 1.1920929e-07) as iou from c), t as (select *, avg(iou) over w + stddev_samp(iou) over w as least from v window w as (partition by image_id, box_id)),
m as (select *, row_number() over (partition by image_id, level, place, shape order by iou desc, box_id) q from t where iou >= least and ax > xmin + 0.01 and ax < xmax - 0.01 and ay > ymin + 0.01 and ay < ymax - 0.01)
select image_id, level, cast(place as bigint) as place, shape, box_id, round(iou, 5) as iou from m where q = 1""")
def anchor_matching(s, d):
    m = DT.match_anchors(boxes(s, d).select("image_id", "box_id", *SIDES), ["image_id"], "box_id", GRIDS, STRIDES, shapes())
    return m.select("image_id", "level", "place", "shape", "box_id", r5("iou").alias("iou"))


@query(BOXES + "select box_id, image_id, round(xmin + ymax, 5) as second, round(xmin, 5) as xmin, round(ymax, 5) as ymax from b where label in (1)")
def box_points(s, d):
    """Corners of the boxes of some labels as points, and the boxes around these."""
    x = DT.select_labels(boxes(s, d), "label", [1]).withColumn("p", DT.points_of_boxes())
    b = DT.boxes_of_points(F.col("p"))
    return x.select("box_id", "image_id", r5(F.col("p")[1][0] + F.col("p")[1][1]).alias("second"), r5(b["xmin"]).alias("xmin"), r5(b["ymax"]).alias("ymax"))


@query(BOXES + f", m as (select image_id, arg_min((xmin + xmax) / 2, ({unit_sql("concat(image_id, '/', box_id)", '2')}, box_id, (xmin + xmax) / 2, (ymin + ymax) / 2)) as mx, arg_min((ymin + ymax) / 2, ({unit_sql("concat(image_id, '/', box_id)", '2')}, box_id, (xmin + xmax) / 2, (ymin + ymax) / 2)) as my from b group by 1), s as (select image_id, least(greatest(floor(mx) - 20, 0), 160) as sx, least(greatest(floor(my) - 25, 0), 250) as sy from m), z as (select box_id, image_id, least(greatest(xmin - sx, 0), 40) as xmin, least(greatest(ymin - sy, 0), 50) as ymin, least(greatest(xmax - sx, 0), 40) as xmax, least(greatest(ymax - sy, 0), 50) as ymax from b join s using (image_id)) select box_id, image_id, {_ALL} from z where xmax >= xmin + 1 and ymax >= ymin + 1")
def box_random_crop(s, d):
    """Boxes in a crop of 40 x 50 about one drawn box of each image of 200 x 300."""
    return _sides(DT.rand_crop_by_box(boxes(s, d), "image_id", "box_id", (40, 50), (200, 300), 2))
