"""Queries of traced, inverted and lazily composed spatial steps; embeddings serve as 8 x 8 and 4 x 4 x 4 arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import resampling as R
from stratalens.operators import traced as T
from stratalens.plans.catalogue_arrays import vectors
from stratalens.plans.catalogue_detection import unit_sql
from stratalens.plans.registry import query

_E = "with e as (select vec_id, cast(i as int) as i, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) "


def arrays(s, d, *shape):
    return vectors(s, d).select("vec_id", F.col("v").alias("data"), F.array(*map(F.lit, shape)).alias("shape"))


def cells(df, data="data"):
    return df.select("vec_id", F.posexplode(data).alias("cell", "value")).withColumn("value", F.round("value", 5))


_TURNED = f""", f as (select vec_id, i, x, case when {unit_sql('vec_id', '21a0')} < 0.5 then 7 - i // 8 else i // 8 end as a, case when {unit_sql('vec_id', '21a1')} < 0.5 then 7 - i % 8 else i % 8 end as b, cast(floor({unit_sql('vec_id', '22')} * 4) as int) as k from e),
r as (select vec_id, i, x, case k when 1 then 7 - b when 2 then 7 - a when 3 then b else a end as a, case k when 1 then a when 2 then 7 - b when 3 then 7 - a else b end as b from f) """
STEPS = (T.flip(0.5, 21), T.rotate90(3, 22))


@query(_E[:-1] + _TURNED + f"select vec_id, i as cell, round(x, 5) as value from r where a - floor({unit_sql('vec_id', '23c0')} * 3) between 0 and 5 and b - floor({unit_sql('vec_id', '23c1')} * 3) between 0 and 5")
def trace_inverse(s, d):
    """Mirrored, turned, cropped, padded and zoomed by draws, then put back by the trace: the cells that the crop left."""
    x = arrays(s, d, 8, 8).withColumn("mask", F.transform("data", lambda v: F.lit(1.0)))
    steps = [*STEPS, T.crop((6, 6), 23), T.pad(2, 24), T.zoom(1.0, 1.6, 25)]
    mask = T.invert(T.apply(x.select("vec_id", "mask", "shape"), steps, "vec_id", 2, data="mask"), 2, data="mask")
    back = T.invert(T.apply(x.drop("mask"), steps, "vec_id", 2), 2)
    both = back.select("vec_id", "data").join(mask.select("vec_id", "mask"), "vec_id").select("vec_id", F.posexplode(F.arrays_zip("data", "mask")).alias("cell", "p"))
    return both.where("p.mask = 1").select("vec_id", "cell", F.round("p.data", 5).alias("value"))


@query(_E + "select vec_id, i as cell, round(x, 5) as value from e")
def trace_inverse_nd(s, d):
    """Steps in space that lose nothing, some of them only on a part of the rows: the inverse is the input."""
    steps = [T.some(T.flip(0.5, 31), 0.6, 7), T.rotate90(3, 32, (1, 2)), T.pad(2, 33), T.zoom(1.0, 1.5, 34)]
    return cells(T.invert(T.apply(arrays(s, d, 4, 4, 4), steps, "vec_id", 3), 3))


@query(_E[:-1] + _TURNED + "select vec_id, cast(count(*) filter (where x > 0) as bigint) as n_cells, cast(coalesce(sum(i) filter (where x > 0), 0) as bigint) as places from r group by 1")
def trace_batch_inverse(s, d):
    """Masks made from transformed images, put back onto the images by their traces."""
    images = T.apply(arrays(s, d, 8, 8), [*STEPS, T.pad(1, 26)], "vec_id", 2)
    masks = images.select("vec_id", F.transform("data", lambda v: (v > 0).cast("double")).alias("data"), "shape")
    back = T.invert_with(masks, images, ["vec_id"], 2)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q).cast("long")
    return back.select("vec_id", total(F.col("data")).alias("n_cells"), total(F.transform("data", lambda v, i: v * i)).alias("places"))


@query(_E[:-1] + f""", k as (select distinct vec_id, cast(floor({unit_sql('vec_id', '41')} * 4) as int) as k from e), o as (select vec_id, k, cast(c as int) as cell, (c // 16 - 1) / 2.0::double - 0.25 as y, (c % 16 + 2) / 2.0::double - 0.25 as z from k, unnest(range(256)) as u(c)),
p as (select vec_id, cell, floor(case k when 1 then z when 2 then 7 - y when 3 then 7 - z else y end + 0.5) as a, floor(case k when 1 then 7 - y when 2 then 7 - z when 3 then y else z end + 0.5) as b from o)
select p.vec_id, p.cell, round(coalesce(e.x, 0), 5) as value from p left join e on e.vec_id = p.vec_id and a between 0 and 7 and b between 0 and 7 and e.i = a * 8 + b""")
def lazy_chain(s, d):
    """A drawn turn, a zoom and a move composed and gathered once."""
    return cells(T.apply_lazily(arrays(s, d, 8, 8), [T.rotate90(3, 41), T.zoom(2.0, 2.0, 42), T.translate((1, -2))], "vec_id", 2))


def _linear(places: str) -> str:
    """SQL of linear interpolation in an 8 x 8 array at places (vec_id, cell, y, z), zeros outside."""
    return _E[:-1] + f""", p as ({places}), c as (select vec_id, cell, floor(y) + j as a, floor(z) + k as b, (case j when 0 then 1 - (y - floor(y)) else y - floor(y) end) * (case k when 0 then 1 - (z - floor(z)) else z - floor(z) end) as w from p, unnest([0, 1]) as s(j), unnest([0, 1]) as t(k))
select c.vec_id, c.cell, round(coalesce(sum(w * e.x), 0), 5) as value from c left join e on e.vec_id = c.vec_id and a between 0 and 7 and b between 0 and 7 and e.i = a * 8 + b group by 1, 2"""


@query(_linear("select vec_id, cast(c as int) as cell, 0.75 * (c // 10) + 0.75::double as y, 0.625 * (c % 10) - 0.5::double as z from embeddings, unnest(range(120)) as u(c)"))
def resample_to_match(s, d):
    """An image of spacing 2 on the grid of one of 12 x 10 finer cells, both placed in the world."""
    own, other = R.matrix([[2.0, 0.0, -1.0], [0.0, 2.0, 3.0]]), R.matrix([[1.5, 0.0, 0.5], [0.0, 1.25, 2.0]])
    return cells(arrays(s, d, 8, 8).withColumn("data", R.resample_to_match(F.col("data"), F.col("shape"), own, F.array(F.lit(12), F.lit(10)), other, 2)))


@query(_E + """, p as (select vec_id, cast(c as int) as cell, least(greatest(floor(0.8::double * (c // 18) + 0.1 + 0.5), 0), 3) as a, least(greatest(floor(1.5::double * (c // 6 % 3) - 0.7 + 0.5), 0), 3) as b, least(greatest(floor(0.9::double * (c % 6) - 0.4 + 0.5), 0), 3) as g from embeddings, unnest(range(90)) as u(c))
select p.vec_id, p.cell, round(e.x, 5) as value from p join e on e.vec_id = p.vec_id and e.i = a * 16 + b * 4 + g""")
def resample_to_match_nd(s, d):
    """A volume on a grid of 5 x 3 x 6 cells by the nearest one; beyond its ends those of its border."""
    world = R.matrix([[0.5, 0.0, 0.0, 1.0], [0.0, 2.0, 0.0, -3.0], [0.0, 0.0, 1.0, 0.25]])
    m = R.matrix([[0.8, 0.0, 0.0, 0.1], [0.0, 1.5, 0.0, -0.7], [0.0, 0.0, 0.9, -0.4]])
    x = arrays(s, d, 4, 4, 4).withColumn("target", R.compose(world, m, 3))
    return cells(x.withColumn("data", R.resample_to_match(F.col("data"), F.col("shape"), world, F.array(*map(F.lit, (5, 3, 6))), F.col("target"), 3, "nearest", border=True)))


@query(_linear("select vec_id, cast(c as int) as cell, c // 8 + (c % 5 - 2) * 0.3::double as y, c % 8 + ((c + 64) % 5 - 2) * 0.3::double as z from embeddings, unnest(range(64)) as u(c)"))
def displacement_field(s, d):
    """A field of displacements added to the places that are read."""
    field = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (i % 5 - 2) * 0.3)
    return cells(T.apply_lazily(arrays(s, d, 8, 8), [], "vec_id", 2, "linear", displacement=field))


@query("select box_id, round(1.5 * x + 0.5 * y - 7, 6) as wx, round(2 * y + 4, 6) as wy, round(x, 6) as vx, round(y, 6) as vy from (select l_orderkey * 10 + l_linenumber as box_id, l_quantity::double as x, l_discount::double * 100 as y from lineitem where l_linenumber = 1)")
def voxel_world_points(s, d):
    """Points from voxels to the world and back."""
    from stratalens.session import read_table

    m = R.matrix([[1.5, 0.5, -7.0], [0.0, 2.0, 4.0]])
    rows = read_table(s, d, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), F.array(F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100)).alias("p"))
    rows = rows.withColumn("w", R.apply_to_points(m, F.col("p"), 2))
    rows = rows.withColumn("v", R.apply_to_points(R.inverse(m, 2), F.col("w"), 2))
    return rows.select("box_id", *[F.round(F.col(c)[0][k], 6).alias(f"{n}{'xy'[k]}") for c, n in (("w", "w"), ("v", "v")) for k in range(2)])
