"""Queries of fast transforms: long signals, all axes of volumes, wavelets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import complexes as C
from stratalens.functions import fourier as FT
from stratalens.plans.catalogue_arrays import vectors
from stratalens.plans.registry import query

_E = "with e as (select vec_id, cast(i as int) as i, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) "
N = 1920


def _complex(v="v"):
    return F.transform(v, lambda x: F.struct(x.alias("re"), F.lit(0.0).alias("im")))


def r4(c):
    return F.round(c, 4)


@query(_E[:-1] + f""", s as (select vec_id // 30 as signal, (vec_id % 30) * 64 + i as t, x from e), f as (select signal from s group by 1 having count(*) = {N}), k as (select unnest([0, 1, 7, 64, 333, 960, 1919]) as k)
select signal, cast(k as int) as k, round(sum(x * cos(2 * pi() * ((k * t) % {N}) / {N})) / sqrt({N}), 4) as re, round(-sum(x * sin(2 * pi() * ((k * t) % {N}) / {N})) / sqrt({N}), 4) as im from s join f using (signal), k group by 1, 2""")
def fourier_long(s, d):
    """Signals of 1,920 = 2^7 x 3 x 5 samples, some of their frequencies."""
    x = vectors(s, d).groupBy(F.floor(F.col("vec_id") / 30).alias("signal")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("p"))  # thirty pieces
    x = x.where("size(p) = 30").select("signal", F.flatten(F.transform("p", lambda q: q["v"])).alias("v"))
    x = x.select("signal", FT.fft(_complex(), N).alias("z"))
    x = x.select("signal", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("z")[k].alias("z")) for k in (0, 1, 7, 64, 333, 960, 1919)])).alias("r"))
    return x.select("signal", "r.k", r4("r.z.re").alias("re"), r4("r.z.im").alias("im"))


@query(_E + "select e.vec_id, cast(k as int) as cell, round(sum(x * cos(2 * pi() * ((k // 16) * (i // 16) / 4.0::double + (k // 4 % 4) * (i // 4 % 4) / 4.0::double + (k % 4) * (i % 4) / 4.0::double))) / 8, 4) as re, round(-sum(x * sin(2 * pi() * ((k // 16) * (i // 16) / 4.0::double + (k // 4 % 4) * (i // 4 % 4) / 4.0::double + (k % 4) * (i % 4) / 4.0::double))) / 8, 4) as im from e, unnest(range(64)) as u(k) group by 1, 2")
def fourier_nd(s, d):
    """All three axes of volumes."""
    x = vectors(s, d).select("vec_id", F.posexplode(FT.fftn(_complex(), (4, 4, 4))).alias("cell", "z"))
    return x.select("vec_id", "cell", r4("z.re").alias("re"), r4("z.im").alias("im"))


@query(_E + "select e.vec_id, cast(k as int) as cell, round(sqrt(pow(sum(x * cos(2 * pi() * ((k // 8 - 4) * (i // 8 - 4) / 8.0::double + (k % 8 - 4) * (i % 8 - 4) / 8.0::double))) / 8, 2) + pow(sum(x * sin(2 * pi() * ((k // 8 - 4) * (i // 8 - 4) / 8.0::double + (k % 8 - 4) * (i % 8 - 4) / 8.0::double))) / 8, 2)), 4) as size from e, unnest(range(64)) as u(k) group by 1, 2")
def fourier_centered(s, d):
    """Planes with the origin in the middle."""
    x = vectors(s, d).select("vec_id", F.posexplode(C.absolute(FT.centered(_complex(), (8, 8)))).alias("cell", "size"))
    return x.withColumn("size", r4("size"))


@query(_E[:-1] + """, w as (select unnest([1.0, 2.5, 4.0])::double as w), h as (select w, cast(t as int) as t, 2 / (sqrt(3 * w) * pow(pi(), 0.25)) * (1 - pow(t / w, 2)) * exp(-pow(t / w, 2) / 2) as h from w, unnest(range(-32, 33)) as u(t) where abs(t) <= ceil(8 * w))
select e.vec_id, h.w as width, cast(e.i + h.t as int) as place, round(sum(x * h), 4) as coefficient from e, h where e.i + h.t between 0 and 63 group by 1, 2, 3""")
def wavelet_transform(s, d):
    """Continuous wavelets of three widths."""
    widths = (1.0, 2.5, 4.0)
    x = vectors(s, d).select("vec_id", FT.wavelets(F.col("v"), 64, widths).alias("c"))
    rows = F.array(*[F.struct(F.lit(w).alias("width"), F.col("c")[k].alias("v")) for k, w in enumerate(widths)])
    return x.select("vec_id", F.explode(rows).alias("r")).select("vec_id", "r.width", F.posexplode("r.v").alias("place", "coefficient")).withColumn("coefficient", r4("coefficient"))
