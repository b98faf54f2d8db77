"""Queries of surfaces, points, crop centres, label transforms, lesions, case summaries and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import points as PO
from stratalens.functions import surfaces as SU
from stratalens.functions.nd import Nd
from stratalens.operators import interactive as IA
from stratalens.operators import lesions as L
from stratalens.operators import profiling as P
from stratalens.operators import records as R
from stratalens.plans.catalogue_arrays import single, vectors
from stratalens.plans.catalogue_detection import unit_sql
from stratalens.plans.registry import query
from stratalens.session import read_table as t


def r5(c):
    return F.round(c, 5)


_M = "with m as (select vec_id, s, cast(i // 8 as int) as a, cast(i % 8 as int) as b from embeddings, unnest(range(64)) as u(i), unnest(range(2)) as v(s) where embedding[i + 1] > s * 0.05 - 0.02), e as (select m.vec_id, m.s, m.a, m.b from m left join m n on m.vec_id = n.vec_id and m.s = n.s and abs(m.a - n.a) + abs(m.b - n.b) = 1 group by all having count(n.a) < 4) "


def masks(s, d):
    cut = lambda at: F.transform("v", lambda x: (x > at).cast("int"))
    return vectors(s, d).select("vec_id", cut(single(-0.02)).alias("p"), cut(single(0.03)).alias("g"))


@query(_M + """, d as (select x.vec_id, x.s, min(sqrt((x.a - y.a) * (x.a - y.a) + pow((x.b - y.b) * 1.5, 2))) as dist, min(greatest(abs(x.a - y.a), abs(x.b - y.b))) as chess, min(abs(x.a - y.a) + abs(x.b - y.b)) as taxi from e x join e y on x.vec_id = y.vec_id and x.s <> y.s group by x.vec_id, x.s, x.a, x.b),
h as (select vec_id, s, max(dist) as m, quantile_cont(dist, 0.95) as q, max(chess) as chess, max(taxi) as taxi from d group by 1, 2)
select vec_id, round(max(m), 5) as hausdorff, round(max(q), 5) as hausdorff95, round(max(case when s = 0 then m end), 5) as directed, cast(max(chess) as double) as chessboard, cast(max(taxi) as double) as taxicab, round((select avg(dist) from d where d.vec_id = h.vec_id), 5) as average, round((select avg(cast(dist <= 1 as double)) from d where d.vec_id = h.vec_id), 5) as dice from h group by vec_id""")
def surfaces_2d(s, d):
    """Surface distances of 8 x 8 masks with spacing (1, 1.5)."""
    x = masks(s, d).select("vec_id", SU.edges(Nd(F.col("p"), (8, 8))).alias("e"), SU.edges(Nd(F.col("g"), (8, 8))).alias("f")).where("size(e) > 0 and size(f) > 0")
    sp = SU.spacing_of([1.0, 1.5], 2)
    e, f = F.col("e"), F.col("f")
    x = x.withColumns({"there": SU.nearest(e, f, sp), "back": SU.nearest(f, e, sp), "c1": SU.nearest(e, f, sp, "chessboard"), "c2": SU.nearest(f, e, sp, "chessboard"), "t1": SU.nearest(e, f, sp, "taxicab"), "t2": SU.nearest(f, e, sp, "taxicab")})
    a, b = F.col("there"), F.col("back")
    return x.select("vec_id", r5(SU.hausdorff(a, b)).alias("hausdorff"), r5(SU.hausdorff(a, b, 95)).alias("hausdorff95"), r5(SU.hausdorff(a, b, directed=True)).alias("directed"), SU.hausdorff(F.col("c1"), F.col("c2")).alias("chessboard"), SU.hausdorff(F.col("t1"), F.col("t2")).alias("taxicab"), r5(SU.average_distance(a, b, True)).alias("average"), r5(SU.surface_dice(a, b, 1.0)).alias("dice"))


_V = "with m as (select vec_id, s, cast(i // 16 as int) as a, cast(i // 4 % 4 as int) as b, cast(i % 4 as int) as c from embeddings, unnest(range(64)) as u(i), unnest(range(2)) as v(s) where embedding[i + 1] > s * 0.05 - 0.02), e as (select m.vec_id, m.s, m.a, m.b, m.c from m left join m n on m.vec_id = n.vec_id and m.s = n.s and abs(m.a - n.a) + abs(m.b - n.b) + abs(m.c - n.c) = 1 group by all having count(n.a) < 6) "


@query(_V + ", d as (select x.vec_id, min(sqrt((x.a - y.a) * (x.a - y.a) * 4 + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c))) as dist from e x join e y on x.vec_id = y.vec_id and x.s <> y.s group by x.vec_id, x.s, x.a, x.b, x.c) select vec_id, round(max(dist), 5) as hausdorff, round(avg(dist), 5) as average from d group by 1")
def surfaces_3d(s, d):
    """Surface distances of 4 x 4 x 4 masks with spacing (2, 1, 1)."""
    x = masks(s, d).select("vec_id", SU.edges(Nd(F.col("p"), (4, 4, 4))).alias("e"), SU.edges(Nd(F.col("g"), (4, 4, 4))).alias("f")).where("size(e) > 0 and size(f) > 0")
    x = x.withColumns({"there": SU.nearest(F.col("e"), F.col("f"), [2, 1, 1]), "back": SU.nearest(F.col("f"), F.col("e"), [2, 1, 1])})
    return x.select("vec_id", r5(SU.hausdorff(F.col("there"), F.col("back"))).alias("hausdorff"), r5(SU.average_distance(F.col("there"), F.col("back"), True)).alias("average"))


@query("select vec_id, round(0.5 * embedding[1] - 2 * embedding[2] + 3, 5) as x0, round(cast(embedding[3] as double) + embedding[4] - 1, 5) as y1 from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as embedding from embeddings)")
def transform_points(s, d):
    p = PO.transform_points(F.array(F.array(F.col("v")[0], F.col("v")[1]), F.array(F.col("v")[2], F.col("v")[3])), [[0.5, -2, 3], [1, 1, -1], [0, 0, 1]])
    return vectors(s, d).withColumn("p", p).select("vec_id", r5(F.col("p")[0][0]).alias("x0"), r5(F.col("p")[1][1]).alias("y1"))


_IX = "with e as (select vec_id, list_filter(range(64), lambda i: embedding[i + 1] > 0.1) as fg, list_filter(range(64), lambda i: not embedding[i + 1] > 0.1) as bg from embeddings), k as (select vec_id, fg, bg, k, concat(vec_id, '/', k) as key from e, unnest(range(4)) as u(k)) "
_CLAMP = "select vec_id, cast(k as int) as k, cast(least(greatest(pos // 8, 2), 5) as int) as a, cast(least(greatest(pos % 8, 1), 6) as int) as b from p"


@query(_IX + f", q as (select *, case when {unit_sql('key', '5side')} < case when len(fg) = 0 then 0.0 when len(bg) = 0 then 1.0 else 0.75 end then fg else bg end as use from k), p as (select vec_id, k, use[cast(floor({unit_sql('key', '5at')} * len(use)) as int) + 1] as pos from q) " + _CLAMP)
def crop_centers(s, d):
    """Four crop centres of 8 x 8 arrays for crops of 5 x 3 cells (two and one on either side), three of four on foreground."""
    fg, bg = PO.indices_of(F.transform("v", lambda x: x > single(0.1)), True), PO.indices_of(F.transform("v", lambda x: x > single(0.1)), False)
    x = vectors(s, d).withColumn("c", PO.crop_centers(fg, bg, F.col("vec_id"), 4, 0.75, (5, 3), (8, 8), 5))
    return x.select("vec_id", F.posexplode("c").alias("k", "c")).select("vec_id", "k", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


@query(_IX.replace("0.1)", "0.2)") + f", q as (select *, case when {unit_sql('key', '6class')} * (case when len(bg) > 0 then 1.0 else 0 end + case when len(fg) > 0 then 2.0 else 0 end) < case when len(bg) > 0 then 1.0 else 0 end then bg else fg end as use from k), p as (select vec_id, k, use[cast(floor({unit_sql('key', '6at')} * len(use)) as int) + 1] as pos from q) " + _CLAMP)
def crop_centers_by_class(s, d):
    high = F.transform("v", lambda x: x > single(0.2))
    at = [PO.indices_of(high, False), PO.indices_of(high, True)]
    x = vectors(s, d).withColumn("c", PO.class_crop_centers(at, [1.0, 2.0], F.col("vec_id"), 4, (5, 3), (8, 8), 6))
    return x.select("vec_id", F.posexplode("c").alias("k", "c")).select("vec_id", "k", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


@query("with m as (select vec_id, i, cast(i // 8 as int) as a, cast(i % 8 as int) as b from embeddings, unnest(range(64)) as u(i) where embedding[i + 1] > 0.1) select vec_id, arg_min(a * 8 + b, (a, i)) as top, arg_min(a * 8 + b, (-a, i)) as bottom, arg_min(a * 8 + b, (b, i)) as first, arg_min(a * 8 + b, (-b, i)) as last from m group by 1")
def extreme_points(s, d):
    x = vectors(s, d).withColumn("p", PO.extreme_points(Nd(F.col("v"), (8, 8)), single(0.1))).where("p is not null")
    code = lambda k: F.col("p")[k][0] * 8 + F.col("p")[k][1]
    return x.select("vec_id", *[code(k).alias(n) for k, n in enumerate(("top", "bottom", "first", "last"))])


@query("with p as (select vec_id, (vec_id % 8) as a, (vec_id % 5) as b from embeddings), c as (select vec_id, i // 8 as x, i % 8 as y, pow(i // 8 - a, 2) + pow(i % 8 - b, 2) as d1, pow(i // 8 - 7, 2) + pow(i % 8, 2) as d2 from p, unnest(range(64)) as u(i)), g as (select *, exp(-d1 / 8) + exp(-d2 / 8) as raw from c), n as (select *, (raw - min(raw) over (partition by vec_id)) / (max(raw) over (partition by vec_id) - min(raw) over (partition by vec_id)) as y2 from g) select vec_id, count(*) filter (where d1 <= 4 or d2 <= 4) as cells, round(sum(y2), 4) as signal from n group by 1")
def guidance(s, d):
    """Discs of radius 2 and bell curves of deviation 2 around two clicks."""
    p = F.array(F.array((F.col("vec_id") % 8).cast("int"), (F.col("vec_id") % 5).cast("int")), F.array(F.lit(7), F.lit(0)))
    x = vectors(s, d).select("vec_id", PO.discs(p, (8, 8), 2).alias("disc"), PO.guidance_signal(p, (8, 8), 2.0).alias("bell"))
    return x.select("vec_id", F.aggregate("disc", F.lit(0).cast("long"), lambda a, b: a + b).alias("cells"), F.round(F.aggregate("bell", F.lit(0.0), lambda a, b: a + b), 4).alias("signal"))


@query("select vec_id, list_filter(range(4), lambda k: list_max(embedding[k * 16 + 1 : k * 16 + 16]) > 0.25)::varchar as slices, cast(len(list_filter(range(64), lambda i: embedding[i + 1] > 0.05 and not embedding[64 - i] > 0.05)) as int) as missed, cast(len(list_filter(range(64), lambda i: not embedding[i + 1] > 0.05 and embedding[64 - i] > 0.05)) as int) as wrong from embeddings")
def label_discrepancy(s, d):
    """Slices of a 4 x 16 label with foreground, and what a prediction (the label reversed) misses and adds."""
    miss, wrong = IA.discrepancy(F.col("v"), F.reverse("v"), single(0.05))
    text = F.concat(F.lit("["), F.array_join(F.transform(IA.valid_slices(Nd(F.col("v"), (4, 16)), 0.25), lambda k: k.cast("string")), ", "), F.lit("]"))
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    return vectors(s, d).select("vec_id", text.alias("slices"), add(miss).alias("missed"), add(wrong).alias("wrong"))


_L = "with l as (select vec_id, list_transform(embedding, lambda x: case when x > 0.15 then 3 when x > 0.05 then 2 when x > 0 then 1 else 0 end) as l from embeddings) "


def labels(s, d):
    return vectors(s, d).select("vec_id", F.transform("v", lambda x: F.when(x > single(0.15), 3).when(x > single(0.05), 2).when(x > 0, 1).otherwise(0)).alias("l"))


@query(_L + f", s as (select vec_id, l, list_filter([1, 2, 3], lambda x: list_contains(l, x)) as there from l), p as (select *, there[cast(floor({unit_sql('vec_id', '7')} * len(there)) as int) + 1] as drawn from s) select vec_id, cast(list_sum(list_transform(l, lambda x: case x when 1 then 2 when 2 then 0 when 3 then 1 else 0 end)) as int) as relabelled, drawn, cast(len(list_filter(l, lambda x: x = drawn)) as int) as cells, cast(len(list_filter(l, lambda x: x = 2)) as int) as two, cast(len(list_filter(l, lambda x: x not in (0, 2))) as int) as others from p")
def label_transforms(s, d):
    """Labels normalised by names, one drawn label as a mask, one instance against the others."""
    _, moved = IA.normalised_labels({"liver": 3, "spleen": 1, "other": 2, "background": 0}, ["liver", "spleen"])
    x = labels(s, d)
    drawn, mask = IA.select_label(F.col("l"), "vec_id", [1, 2, 3], 7)
    one, rest = IA.split_label(F.col("l"), 2, 1)
    add = lambda a: F.aggregate(a, F.lit(0), lambda p, q: p + q)
    return x.select("vec_id", add(IA.relabel(F.col("l"), moved)).alias("relabelled"), drawn.alias("drawn"), add(mask).alias("cells"), add(one).alias("two"), add(rest).alias("others"))


@query("with p as (select vec_id, [vec_id % 7, vec_id % 11] as p, [vec_id % 3 + 4, 9] as q from embeddings) select vec_id, cast(round_even(p[1] * 1.5, 0) as int) as x, cast(round_even(q[2] * 0.7, 0) as int) as y, cast(greatest(least(p[1], q[1]) - 2, 0) as int) as start0, cast(least(greatest(p[2], q[2]) + 1 + 1, 12) as int) as end1 from p")
def guidance_geometry(s, d):
    i = lambda c: c.cast("int")
    v = F.col("vec_id")
    p = F.array(F.array(i(v % 7), i(v % 11)), F.array(i(v % 3 + 4), F.lit(9)))
    r = IA.resize_guidance(p, (10, 10), (15, 7))
    b = IA.guidance_box(p, 2, (2, 1), (12, 12))
    return t(s, d, "embeddings").select("vec_id", r[0][0].alias("x"), r[1][1].alias("y"), b["start0"].alias("start0"), b["end1"].alias("end1"))


def _cells(s, d):
    """A labelled grid from order lines: image by order, cell by line and part."""
    x = t(s, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("label")).groupBy("image", "x", "y").agg(F.max("label").alias("label"))


_C = "with c as (select l_orderkey as image, cast(l_partkey % 16 as int) as x, cast(l_suppkey % 16 as int) as y, max(case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end) as label from lineitem group by 1, 2, 3), o as (select l_orderkey as image, cast(l_partkey % 16 as int) as x, cast(l_suppkey % 16 as int) as y, round(l_discount + l_tax, 2) as score from lineitem where l_linenumber % 2 = 0) "


@query(_C + ", i as (select image, label from c where label <> 0 group by 1, 2 having greatest(max(x) - min(x), max(y) - min(y)) + 1 < 3), j as (select o.image, score, coalesce(label, 0) as label from o left join c using (image, x, y)), k as (select * from j where not exists (select 1 from i where i.image = j.image and i.label = j.label)) select 'false' as kind, image, 0 as label, score, count(*) as n from k where label = 0 group by all union all select 'true', image, label, max(score), 1 from k where label <> 0 group by image, label")
def lesion_hits(s, d):
    """Detections on lesions (the best of each), beside lesions, and none on isolated cells."""
    c = _cells(s, d)
    o = t(s, d, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("score"))
    false, true = L.lesion_hits(o, c, "image", ["x", "y"], "score", "label", L.isolated_cells(c, "image", "label", ["x", "y"], 3))
    a = false.groupBy("image", "score").agg(F.count("*").alias("n")).select(F.lit("false").alias("kind"), "image", F.lit(0).alias("label"), "score", "n")
    return a.unionByName(true.select(F.lit("true").alias("kind"), "image", "label", "score", F.lit(1).cast("long").alias("n")))


@query(_C + ", m as (select image, label, avg(x) as mx, avg(y) as my, min(x) as lx, max(x) as hx, count(*) as cells from c where label <> 0 group by 1, 2), b as (select c.image, c.label, count(*) as border from c where label <> 0 and (select count(*) from c n where n.image = c.image and n.label = c.label and abs(n.x - c.x) + abs(n.y - c.y) = 1) < 4 group by 1, 2), h as (select c.image, c.label, round(sum(case when x < round(mx) and round(mx) > lx then (x - round(mx)) / (round(mx) - lx) when x > round(mx) and hx > round(mx) then (x - round(mx)) / (hx - round(mx)) else 0 end), 5) as horizontal from c join m using (image, label) group by 1, 2) select image, label, round(mx, 5) as x, round(my, 5) as y, cells, border, horizontal from m join b using (image, label) join h using (image, label)")
def instance_shapes(s, d):
    """Centroids, border cells and horizontal distance maps of instances."""
    c = _cells(s, d)
    m = L.instance_centroids(c, "image", "label", ["x", "y"]).select("image", "label", r5("x").alias("x"), r5("y").alias("y"), "cells")
    b = L.instance_borders(c, "image", "label").groupBy("image", "label").agg(F.count("*").alias("border"))
    h = L.hover_maps(c, "image", "label").groupBy("image", "label").agg(r5(F.sum("horizontal")).alias("horizontal"))
    return m.join(b, ["image", "label"]).join(h, ["image", "label"])


@query("with c as (select l_orderkey, l_returnflag as label, count(*) as n, avg(l_quantity) as mean, min(l_quantity) as min, max(l_quantity) as max, stddev_pop(l_quantity) as stdev from lineitem group by 1, 2) select label, count(*) as cases, cast(sum(n) as bigint) as cells, max(max) as max, min(min) as min, round(avg(mean), 5) as mean, round(avg(stdev), 5) as stdev from c group by 1")
def label_stats_summary(s, d):
    x = P.label_stats_summary(P.label_stats_by_case(t(s, d, "lineitem").withColumnRenamed("l_returnflag", "label"), "l_orderkey", "label", "l_quantity"), "label")
    return x.select("label", "cases", "cells", "max", "min", r5("mean").alias("mean"), r5("stdev").alias("stdev"))


@query("with recursive e as (select vec_id, cast(i as int) as i, i // 8 as a, i % 8 as b from embeddings, unnest(range(64)) as u(i) where embedding[i + 1] > 0), n as (select x.vec_id, x.i, y.i as j from e x join e y on x.vec_id = y.vec_id and abs(x.a - y.a) + abs(x.b - y.b) = 1), r(vec_id, i, root) as (select vec_id, i, i from e union select n.vec_id, n.j, r.root from r join n on r.vec_id = n.vec_id and r.i = n.i where r.root < n.j), c as (select vec_id, i, min(root) as root from r group by 1, 2), g as (select vec_id, root, count(*) as n, max(i // 8) - min(i // 8) + 1 as h, max(i % 8) - min(i % 8) + 1 as w from c group by 1, 2) select vec_id, count(*) as components, cast(arg_min(h, (-n, root)) as int) as height, cast(arg_min(w, (-n, root)) as int) as width from g group by 1")
def label_component_shapes(s, d):
    """Number of the components of a label, and the shape of its largest."""
    from stratalens.functions import tensors as X
    from stratalens.plans.catalogue_more import _images

    n = X.apply(_images(s, d), [lambda a: X.components(a > 0)], "vec_id")
    c = n.select("vec_id", F.posexplode("data").alias("i", "component")).where("component > 0").select("vec_id", F.lit(1).alias("label"), "component", F.floor(F.col("i") / 8).alias("a"), (F.col("i") % 8).alias("b"))
    x = P.component_shapes(c, "vec_id", "label", "component", ["a", "b"])
    return x.select("vec_id", "components", F.col("shapes")[0][0].alias("height"), F.col("shapes")[0][1].alias("width"))


@query("select doc_id, 'doc_' || doc_id || '.nii.gz' as name, '.gz' as suffix, doc_id in (select doc_id from labels) as exists from documents")
def filename_stats(s, d):
    name = lambda c: F.concat(F.lit("in/doc_"), c.cast("string"), F.lit(".nii.gz"))
    x = t(s, d, "documents").select("doc_id", name(F.col("doc_id")).alias("file"))
    known = t(s, d, "labels").select(name(F.col("doc_id")).alias("path"))
    return P.filename_stats(x, "file", known).select("doc_id", "name", F.regexp_extract("suffix", r"(\.gz)$", 1).alias("suffix"), "exists")


@query("select n_nationkey, damerau_levenshtein(n_name, r_name) as distance, cast(damerau_levenshtein('abcdef' || n_name, 'bacdfe' || n_name) as bigint) as swapped from nation join region on n_regionkey = r_regionkey")
def edit_distance(s, d):
    x = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    swapped = R.damerau_levenshtein(F.concat(F.lit("abcdef"), "n_name"), F.concat(F.lit("bacdfe"), "n_name"))
    return x.select("n_nationkey", R.damerau_levenshtein(F.col("n_name"), F.col("r_name")).cast("long").alias("distance"), swapped.cast("long").alias("swapped"))


@query("select p_partkey, 'brand=' || p_brand as first, round(cast(p_size * 25.4 as double), 5) as mm, p_size as s from part")
def record_helpers(s, d):
    """Name=value pairs as a map, a nested struct flattened, and units of length."""
    x = t(s, d, "part").select("p_partkey", F.struct(F.struct(F.col("p_size").alias("s")).alias("b"), "p_brand").alias("a"))
    x = R.flatten_struct(x, "a")
    m = R.pairs_to_map(F.array(F.lit("x=1"), F.concat(F.lit("brand="), F.col("`a.p_brand`"))))
    return x.select("p_partkey", F.concat(F.lit("brand="), m["brand"]).alias("first"), r5(F.col("`a.b.s`") * R.unit_factor("inch", "millimeter")).alias("mm"), F.col("`a.b.s`").alias("s"))


_P = "with recursive c as (select vec_id, cast(i as int) as i, i // 8 as a, i % 8 as b, cast(embedding[i + 1] as double) as x, row_number() over (partition by vec_id order by embedding[i + 1] desc, i) as k from embeddings, unnest(range(64)) as u(i) where embedding[i + 1] > 0.1), o as (select z.vec_id, z.k, list(y.k) as before from c y join c z on y.vec_id = z.vec_id and y.k < z.k and z.a >= y.a - 1 and z.a < y.a + 2 and z.b >= y.b - 2 and z.b < y.b + 2 group by all), w as (select c.vec_id, c.k, coalesce(before, []) as before from c left join o using (vec_id, k)), g(vec_id, k, kept) as (select vec_id, k, [k] from w where k = 1 union all select w.vec_id, w.k, case when list_has_any(g.kept, w.before) then g.kept else list_append(g.kept, w.k) end from g join w on g.vec_id = w.vec_id and w.k = g.k + 1), p as (select vec_id, k, row_number() over (partition by vec_id order by k) as n from g where list_contains(kept, k)) "


@query(_P + "select vec_id, cast(n - 1 as int) as n, i as place, round(x, 5) as value from p join c using (vec_id, k) where n <= 6")
def probability_peaks(s, d):
    """At most six peaks of a map of probabilities, boxes of 3 x 4 cells about each suppressed."""
    x = vectors(s, d).select("vec_id", F.posexplode(Nd(F.col("v"), (8, 8)).peaks((3, 4), single(0.1), 6)).alias("n", "p"))
    return x.select("vec_id", "n", F.col("p.place").alias("place"), r5("p.value").alias("value"))


@query("select vec_id, cast(a * 12 + b as int) as cell, round(cast(embedding[cast(floor((a - 2 + 0.5) * 8 / 6) as int) * 8 + cast(floor((b - 5 + 0.5) * 8 / 4) as int) + 1] as double), 5) as value from embeddings, unnest(range(2, 8)) as t(a), unnest(range(5, 9)) as u(b)")
def restored_label(s, d):
    """An 8 x 8 label back in a 10 x 12 image, where it was a crop of 6 x 4 cells at (2, 5)."""
    y = IA.restore_label(Nd(F.col("v"), (8, 8)), (6, 4), (2, 5), (10, 12)).data
    x = vectors(s, d).select("vec_id", F.posexplode(y).alias("cell", "value"))
    a, b = F.floor(F.col("cell") / 12), F.col("cell") % 12
    return x.where((a >= 2) & (a < 8) & (b >= 5) & (b < 9)).select("vec_id", "cell", r5("value").alias("value"))


@query("with p as (select vec_id, vec_id % 8 as a, vec_id % 5 as b, embedding from embeddings) select vec_id, round(sum(case when a + i - 1 between 0 and 7 and b + j - 2 between 0 and 7 then cast(embedding[(a + i - 1) * 8 + b + j - 2 + 1] as double) * (i * 4 + j + 1) else 0 end), 4) as checksum from p, unnest(range(3)) as t(i), unnest(range(4)) as u(j) group by 1")
def click_patch(s, d):
    """The 3 x 4 box about a click, weighted by place."""
    x = vectors(s, d).withColumn("clicks", F.array(F.array((F.col("vec_id") % 8).cast("int"), (F.col("vec_id") % 5).cast("int"))))
    x = IA.click_patches(x, Nd(F.col("v"), (8, 8)), "clicks", (3, 4))
    total = F.aggregate(F.transform("patch", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", F.round(total, 4).alias("checksum"))


@query(_L + "select vec_id, list_filter(range(4), lambda k: list_contains(l[k * 16 + 1 : k * 16 + 16], 3))::varchar as three, list_filter(range(4), lambda k: list_contains(l[k * 16 + 1 : k * 16 + 16], 1))::varchar as one, not list_contains(list_transform(range(64), lambda i: l[i + 1] <> 0 and (i // 8 < 1 or i // 8 > 6 or i % 8 < 1 or i % 8 > 6)), true) as clear from l")
def label_slices(s, d):
    """Slices of a 4 x 16 array that hold label 3 or 1, and whether an 8 x 8 array has zero margins."""
    by = IA.valid_slices_of_labels(Nd(F.col("l"), (4, 16)), {"three": 3, "one": 1})
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda k: k.cast("string")), ", "), F.lit("]"))
    return labels(s, d).select("vec_id", text(by["three"]).alias("three"), text(by["one"]).alias("one"), Nd(F.col("l"), (8, 8)).margins_are_zero(1).alias("clear"))


@query("with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), a as (select vec_id, list_transform(range(64), lambda i: case when greatest(v[i + 1], v[64 - i], -v[i + 1] / 2) <= 0.05 then 0 when v[i + 1] >= v[64 - i] and v[i + 1] >= -v[i + 1] / 2 then 5 when v[64 - i] >= -v[i + 1] / 2 then 7 else 9 end) as l, v from e) select vec_id, cast(list_sum(l) as bigint) as labels, round(list_sum(list_transform(range(64), lambda i: v[i + 1] * ((i // 8 + 4) % 8 * 8 + (i % 8 + 4) % 8 + 1))), 4) as shifted from a")
def argmax_and_shift(s, d):
    """Labels of the greatest of three channels, and frequencies with the first cell in the middle."""
    v = F.col("v")
    l = IA.argmax_labels([v, F.reverse(v), F.transform(v, lambda x: -x / 2)], [5, 7, 9], 0.05)
    y = Nd(v, (8, 8)).shift_frequencies().data
    total = F.aggregate(F.transform(y, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return vectors(s, d).select("vec_id", F.aggregate(l, F.lit(0).cast("long"), lambda a, b: a + b).alias("labels"), F.round(total, 4).alias("shifted"))
