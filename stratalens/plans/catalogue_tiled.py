"""Queries of cell tables across tiles; fifty embeddings at a time serve as the rows of an image of 50 x 64 cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import contours as C
from stratalens.operators import stains as ST
from stratalens.operators import tiled as T
from stratalens.plans.catalogue_arrays import vectors
from stratalens.plans.registry import query

_C = "with recursive c as materialized (select vec_id // 50 as image, vec_id % 50 as y, cast(i as bigint) as x, cast(embedding[i + 1] as double) as v from embeddings, unnest(range(64)) as u(i)), s as (select unnest([0, 0, 1, -1]) as dy, unnest([1, -1, 0, 0]) as dx), "
#: First cell of each component of the cells of ``m``, as place = y * 2^31 + x.
_REACH = "reach(image, y, x, root) as (select image, y, x, y * 2147483648 + x from m union select m.image, m.y, m.x, r.root from reach r, s join m on m.image = r.image and m.y = r.y + dy and m.x = r.x + dx where r.root < m.y * 2147483648 + m.x), k as materialized (select image, y, x, min(root) as component from reach group by 1, 2, 3) "
BY, AT = ["image"], ["y", "x"]


def cells(s, d):
    x = vectors(s, d).select(F.floor(F.col("vec_id") / 50).alias("image"), (F.col("vec_id") % 50).alias("y"), F.posexplode("v").alias("x", "v"))
    return x.withColumn("x", F.col("x").cast("long"))


def _number(y="y", x="x"):
    return F.col(y) * 64 + F.col(x)


@query(_C + "m as materialized (select image, y, x from c where v > 0.02), " + _REACH + "select image, y, x, component from k")
def tiled_components(s, d):
    """Connected cells above a threshold, over tiles of 16 x 16."""
    return T.components(cells(s, d).where("v > 0.02"), BY, AT, tile=16)


@query(_C + "m as materialized (select image, y, x from c where v > 0.02), " + _REACH + ", p as (select distinct image, component from k where (y * 64 + x) % 97 = 0 and image % 2 = 0 or (y * 64 + x) % 97 = 48) select image, y, x, component from k semi join p using (image, component)")
def tiled_components_with_points(s, d):
    """Components that hold a positive point."""
    found = T.components(cells(s, d).where("v > 0.02"), BY, AT, tile=16)
    points = cells(s, d).where((_number() % 97).isin(0, 48)).select(*BY, *AT, ((_number() % 97 == 48) | (F.col("image") % 2 == 0)).alias("positive"))
    return T.with_points(found, points, BY, AT, positive="positive")


@query(_C + "m as (select image, y, x from c where v > -0.15), b as (select a as dy, e as dx from unnest(range(-1, 2)) as t(a), unnest(range(-1, 2)) as u(e) where a * a + e * e <= 1), e as (select m.image, m.y, m.x from m, b join m n on n.image = m.image and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = 5) select distinct image, y + dy as y, x + dx as x from e, b")
def tiled_opening(s, d):
    """Eroded and dilated by a disk of radius 1."""
    return T.opened(cells(s, d).where("v > -0.15"), BY, AT, 1)


@query(_C + "m as materialized (select image, y, x from c where v <= 0.02), " + _REACH + ", o as (select distinct image, component from k join (select image, min(y) as y0, max(y) as y1 from c group by 1) using (image) where y in (y0, y1) or x in (0, 63)) select image, y, x from c where v > 0.02 union all select image, y, x from k anti join o using (image, component)")
def tiled_fill_holes(s, d):
    """Cells above a threshold and the holes in them."""
    return T.fill_holes(cells(s, d).where("v > 0.02"), cells(s, d), BY, AT, tile=16)


@query(_C + "w as (select unnest([-1, 0, 1]) as o, unnest([0.25, 0.5, 0.25])::double as w), g as (select image, y + a.o as y, x + b.o as x, sum(v * a.w * b.w) as v from c, w a, w b group by all) select image, y, x, round(g.v, 6) as v from g semi join c using (image, y, x)")
def tiled_smooth(s, d):
    """Smoothed along both axes."""
    return T.smooth(cells(s, d), BY, AT, "v", [0.25, 0.5, 0.25]).withColumn("v", F.round("v", 6))


@query(_C + "m as materialized (select image, y, x from c where v > 0.02), " + _REACH + ", n as (select k.image, component, case when v > 0.12 then 2 when v > 0.07 then 1 else 0 end as type, count(*) as n from k join c using (image, y, x) group by all), b as (select *, row_number() over (partition by image, component order by type <> 0 desc, n desc, type) as r, sum(n) over (partition by image, component) as total from n) select image, component, type, round(n / (total + 1e-6), 6) as share from b where r = 1")
def tiled_instance_types(s, d):
    """The type of most cells of each component, and its share."""
    found = T.components(cells(s, d).where("v > 0.02"), BY, AT, tile=16).withColumn("label", F.col("component") + 1)
    kinds = cells(s, d).withColumn("type", F.when(F.col("v") > 0.12, 2).when(F.col("v") > 0.07, 1).otherwise(0))
    x = T.instance_types(found, kinds, BY, AT)
    return x.select("image", (F.col("label") - 1).alias("component"), "type", F.round("share", 6).alias("share"))


@query()
def tiled_watershed(s, d):
    """Water from every 131st cell over the negated values; held against a flood of whole images in the tests."""
    rows = cells(s, d).withColumns({"h": -F.round("v", 2), "m": F.when(_number() % 131 == 0, _number() + 1).otherwise(0)})
    return T.watershed(rows, BY, AT, "h", "m", tile=16)


@query()
def tiled_instances(s, d):
    """Touching instances told apart: mask, border, distance, markers and water in a row."""
    rows = cells(s, d).withColumns({"p": F.col("v") + 0.5, "b": F.abs("v") * 4})
    return T.separate_instances(rows, BY, AT, "p", "b", [0.25, 0.5, 0.25], 0.45, 0.6, 1, 3, tile=16)


def outlines(s, d):
    found = T.components(cells(s, d).where("v > 0.02"), BY, AT, tile=16).withColumn("label", F.col("component") + 1)
    return C.rings(found, BY)


@query(_C + "m as materialized (select image, y, x from c where v > 0.02), " + _REACH + """, b as (select image, component, y + a as cy, x + e as cx, count(*) as n, count(distinct (y + x) % 2) as kinds from k, unnest([0, 1]) as t(a), unnest([0, 1]) as u(e) group by all),
q as (select image, component, sum(case when n in (1, 3) then 1 when n = 2 and kinds = 1 then 2 else 0 end) as corners from b group by all),
l as (select k.image, k.component, sum(4 - (select count(*) from k o, s where o.image = k.image and o.component = k.component and o.y = k.y + dy and o.x = k.x + dx)) as length, count(*) as area, min(k.y) as least_y, max(k.y) + 1 as most_y, min(k.x) as least_x, max(k.x) + 1 as most_x from k group by 1, 2)
select image, component, cast(area as double) as area, cast(length as bigint) as length, cast(corners as bigint) as corners, least_y, most_y, least_x, most_x from l join q using (image, component)""")
def contour_measures(s, d):
    """Area, length, corners and extent of the outlines of components, summed over an instance's rings."""
    m = C.measures(outlines(s, d), BY)
    out = m.groupBy("image", (F.col("label") - 1).alias("component")).agg(*[F.sum(c).alias(c) for c in ("area", "length", "corners")], *[f(f"{n}_{a}").alias(f"{n}_{a}") for n, f in (("least", F.min), ("most", F.max)) for a in AT])
    return out


_STAINS = """with p as (select vec_id // 50 as image, vec_id, i, [cast(floor(least(greatest(110 + 300 * cast(embedding[3 * i + k + 1] as double) + 60 * k, 0), 255)) as int) for k in range(3)] as v from embeddings, unnest(range(21)) as u(i)),
o as (select image, vec_id, i, -ln(least(v[1] + 1.0::double, 240.0) / 240.0::double) as r, -ln(least(v[2] + 1.0::double, 240.0) / 240.0::double) as g, -ln(least(v[3] + 1.0::double, 240.0) / 240.0::double) as b from p), f as (select * from o where r > 0.15 and g > 0.15 and b > 0.15),
m as (select image, covar_samp(r, r) as a, covar_samp(r, g) as b, covar_samp(r, b) as c, covar_samp(g, g) as d, covar_samp(g, b) as e, covar_samp(b, b) as f from f group by 1 having count(*) > 1),
q as (select *, (a + d + f) / 3 as q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) as w from m),
t as (select *, acos(greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * w * w * w)))) / 3 as t from q),
l as (select *, q + 2 * w * cos(t) as l1, q + 2 * w * cos(t + 2 * pi() / 3) as l3 from t), l2 as (select *, unnest([l1, 3 * q - l1 - l3]) as lam, unnest([1, 2]) as nth from l),
x as (select image, nth, b * e - c * (d - lam) as x, c * b - (a - lam) * e as y, (a - lam) * (d - lam) - b * b as z from l2),
y as (select image, nth, case when x + y + z < 0 then -1 else 1 end / sqrt(x * x + y * y + z * z) as s, x, y, z from x),
v as (select image, max(x * s) filter (nth = 1) as x1, max(y * s) filter (nth = 1) as y1, max(z * s) filter (nth = 1) as z1, max(x * s) filter (nth = 2) as x2, max(y * s) filter (nth = 2) as y2, max(z * s) filter (nth = 2) as z2 from y group by 1),
h as (select image, atan2(r * x1 + g * y1 + b * z1, r * x2 + g * y2 + b * z2) as phi from f join v using (image)), n as (select image, quantile_cont(phi, 0.01) as lo, quantile_cont(phi, 0.99) as hi from h group by 1),
z as (select image, [cos(lo) * x2 + sin(lo) * x1, cos(lo) * y2 + sin(lo) * y1, cos(lo) * z2 + sin(lo) * z1] as lo, [cos(hi) * x2 + sin(hi) * x1, cos(hi) * y2 + sin(hi) * y1, cos(hi) * z2 + sin(hi) * z1] as hi from n join v using (image)),
st as materialized (select image, case when lo[1] > hi[1] then lo else hi end as h, case when lo[1] > hi[1] then hi else lo end as e from z) """


def pixels(s, d):
    value = lambda k: F.floor(F.least(F.greatest(110 + 300 * F.element_at("v", (3 * F.col("i") + k + 1).cast("int")) + 60 * k, F.lit(0.0)), F.lit(255.0))).cast("int")
    x = vectors(s, d).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return x.select(F.floor(F.col("vec_id") / 50).alias("image"), "vec_id", "i", *[value(k).alias(c) for k, c in enumerate("rgb")])


@query(_STAINS + "select image, round(h[1], 5) as h_r, round(h[2], 5) as h_g, round(h[3], 5) as h_b, round(e[1], 5) as e_r, round(e[2], 5) as e_g, round(e[3], 5) as e_b from st")
def stain_vectors(s, d):
    """Directions of both stains of each image."""
    x = ST.extract_stains(pixels(s, d), BY)
    return x.select("image", *[F.round(c, 5).alias(c) for c in x.columns[1:]])


@query(_STAINS + """, g as (select *, h[1] * h[1] + h[2] * h[2] + h[3] * h[3] as hh, e[1] * e[1] + e[2] * e[2] + e[3] * e[3] as ee, h[1] * e[1] + h[2] * e[2] + h[3] * e[3] as he from st),
c as (select image, vec_id, i, (ee * (r * h[1] + g * h[2] + b * h[3]) - he * (r * e[1] + g * e[2] + b * e[3])) / (hh * ee - he * he) as ch, (hh * (r * e[1] + g * e[2] + b * e[3]) - he * (r * h[1] + g * h[2] + b * h[3])) / (hh * ee - he * he) as ce from o join g using (image)),
u as (select image, quantile_cont(ch, 0.99) as th, quantile_cont(ce, 0.99) as te from c group by 1), w as (select vec_id, ch / (th / 1.9705) as h, ce / (te / 1.0308) as e from c join u using (image))
select vec_id, round(sum(240 * exp(-(h * 0.5626 + e * 0.2159))), 3) as r, round(sum(240 * exp(-(h * 0.7201 + e * 0.8012))), 3) as g, round(sum(240 * exp(-(h * 0.4062 + e * 0.5581))), 3) as b from w group by 1""")
def stain_normalized(s, d):
    """Colours after normalisation, summed over the pixels of a row of an image."""
    x = ST.normalize_stains(pixels(s, d), BY, whole=False)
    return x.groupBy("vec_id").agg(*[F.round(F.sum(c), 3).alias(c) for c in "rgb"])
