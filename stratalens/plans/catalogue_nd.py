"""Queries of dense arrays, complex numbers and signals, all in the JVM; embeddings serve as 8 x 8, 4 x 4 x 4 and 1-D arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import complexes as C
from stratalens.functions import signals as S
from stratalens.functions.nd import Nd, split_dim, unravel_indices
from stratalens.plans.catalogue_arrays import single, vectors
from stratalens.plans.catalogue_detection import unit_sql
from stratalens.plans.registry import query

_E = "with e as (select vec_id, cast(i as int) as i, cast(embedding[i + 1] as double) as x from embeddings, unnest(range(64)) as u(i)) "


def cells(df, data):
    return df.select("vec_id", F.posexplode(data).alias("cell", "value")).withColumn("value", F.round("value", 5))


def grid(shape=(8, 8)):
    return Nd(F.col("v"), shape)


def _cells(name, made, target, value="x"):
    """Register a query of an 8 x 8 array against SQL that names each cell's place in the result."""

    @query(_E + f"select vec_id, cast({target} as int) as cell, round({value}, 5) as value from e", name=name)
    def run(s, d):
        return cells(vectors(s, d), made().data)

    return run


_cells("tensor_rotate90", lambda: grid().rotate90(1), "(7 - i % 8) * 8 + i // 8")
_cells("nd_rotate270", lambda: grid().rotate90(3), "(i % 8) * 8 + 7 - i // 8")
_cells("nd_flip", lambda: grid((4, 4, 4)).flip([0, 2]), "(3 - i // 16) * 16 + (i // 4 % 4) * 4 + 3 - i % 4")
_cells("nd_transpose", lambda: grid((2, 4, 8)).transpose([2, 0, 1]), "(i % 8) * 8 + i // 32 * 4 + i // 8 % 4")
_cells("nd_channel_last", lambda: grid((2, 4, 8)).channel_last(), "(i % 32) * 2 + i // 32")
_cells("nd_channel_first", lambda: grid((4, 8, 2)).channel_first(-1), "(i % 2) * 32 + i // 2")


@query(_E + "select vec_id, cast(i // 32 * 64 + k * 32 + i % 32 as int) as cell, round(x, 5) as value from e, unnest(range(2)) as u(k)")
def nd_repeat_channel(s, d):
    return cells(vectors(s, d), grid((2, 4, 8)).repeat_channel(2).data)


@query(_E + "select vec_id, cast(i // 32 * 16 + i % 16 as int) as cell, round(x, 5) as value from e where i // 16 % 2 = 0")
def nd_remove_repeated_channel(s, d):
    return cells(vectors(s, d), grid((4, 16)).remove_repeated_channel(2).data)


@query(_E + "select vec_id, cast(i // 8 % 4 as int) as part, cast(i // 32 * 8 + i % 8 as int) as cell, round(x, 5) as value from e")
def nd_split_dim(s, d):
    x = split_dim(vectors(s, d), "v", (2, 4, 8), 1)
    return x.select("vec_id", "part", F.posexplode("v").alias("cell", "value")).withColumn("value", F.round("value", 5))


_PADS = {"edge": "least(greatest({c}, 0), 7)", "wrap": "({c} + 8) % 8", "symmetric": "case when {c} < 0 then -1 - {c} when {c} > 7 then 15 - {c} else {c} end", "reflect": "case when {c} < 0 then -{c} when {c} > 7 then 14 - {c} else {c} end"}


@query("with p as (select a, b from range(11) t(a), range(10) u(b)), m as (" + " union all ".join(f"select '{m}' as mode, a, b, {f.format(c='(a - 2)')} * 8 + {f.format(c='(b - 1)')} as i from p" for m, f in _PADS.items()) + ") select mode, vec_id, round(sum(cast(embedding[i + 1] as double) * (a * 10 + b + 1)), 4) as checksum from m, embeddings group by 1, 2")
def nd_pad_modes(s, d):
    """Padding by (2, 1) and (1, 1) cells in four modes; sums weighted by the place."""
    x, out = vectors(s, d), None
    for mode in _PADS:
        p = grid().pad([(2, 1), (1, 1)], mode).data
        total = F.aggregate(F.transform(p, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        y = x.select(F.lit(mode).alias("mode"), "vec_id", F.round(total, 4).alias("checksum"))
        out = y if out is None else out.unionByName(y)
    return out


@query(_E + "select vec_id, cast((i // 8 - 2) * 4 + i % 8 - 2 as int) as cell, round(x, 5) as value from e where i // 8 between 2 and 5 and i % 8 between 2 and 5")
def nd_scale_crop(s, d):
    return cells(vectors(s, d), grid().scale_crop([0.5, 0.4]).data)


_GRID = _E[:-1] + ", k as (select unnest(range(-1, 2)) as a), g as (select e.vec_id, cast((e.i // 8 - p.a) * 8 + (e.i % 8 - q.a) as int) as cell, e.x from e, k p, k q where e.i // 8 - p.a between 0 and 7 and e.i % 8 - q.a between 0 and 7) "


@query(_GRID + "select vec_id, cell, round(min(x), 5) as value from g group by 1, 2")
def tensor_erode(s, d):
    return cells(vectors(s, d), grid().erode().data)


@query(_GRID + "select vec_id, cell, round(max(x), 5) as value from g group by 1, 2")
def tensor_dilate(s, d):
    return cells(vectors(s, d), grid().dilate().data)


@query(_GRID + "select vec_id, cell, round(sum(x) / 9, 5) as value from g group by 1, 2")
def nd_mean_filter(s, d):
    return cells(vectors(s, d), grid().mean_filter().data)


_NOISE = f"case when {unit_sql('vec_id', '11p')} < 0.5 then x + sqrt(-2 * ln(1 - {unit_sql("concat(vec_id, '/', i)", '11u')})) * cos(2 * pi() * {unit_sql("concat(vec_id, '/', i)", '11v')}) * {unit_sql('vec_id', '11s')} * 0.1 else x end"


@query(_E + f""", n as (select vec_id, i // 8 as a, i % 8 as b, {_NOISE} as x, cast(floor({unit_sql('vec_id', '12')} * 3) as int) + 1 as k, cast(floor({unit_sql('vec_id', '13')} * 2) as int) as f, cast(floor({unit_sql('vec_id', '14c0')} * 3) as int) as s0, cast(floor({unit_sql('vec_id', '14c1')} * 3) as int) as s1 from e),
r as (select vec_id, x, f, s0, s1, case k when 1 then 7 - b when 2 then 7 - a else b end as a, case k when 1 then a when 2 then 7 - b else 7 - a end as b from n), t as (select vec_id, x, s0, s1, case when f = 0 then 7 - a else a end as a, case when f = 1 then 7 - b else b end as b from r)
select vec_id, cast((a - s0) * 6 + b - s1 as int) as cell, round(x, 5) as value from t where a - s0 between 0 and 5 and b - s1 between 0 and 5""")
def tensor_random_chain(s, d):
    """Noise on half of the arrays, turns, a mirrored axis and a crop, all drawn from each row's key."""
    key = F.col("vec_id")
    x = vectors(s, d)
    for make in (lambda a: a.rand_noise(key, 0.0, 0.1, 0.5, 11), lambda a: a.rand_rotate90(key, 2.0, 3, 12), lambda a: a.rand_axis_flip(key, 2.0, 13)):
        x = x.withColumn("v", make(grid()).data)
    return cells(x, grid().rand_crop(key, (6, 6), 14).data)


@query("select vec_id, list_transform(list_filter(range(64), lambda i: embedding[i + 1] > 0.25), lambda i: (i // 16) * 100 + (i // 4 % 4) * 10 + i % 4)::varchar as codes from embeddings")
def nd_unravel(s, d):
    """Coordinates of the cells of a 4 x 4 x 4 array above a threshold, as digits."""
    at = F.filter(F.transform("v", lambda x, i: F.when(x > 0.25, i)), lambda i: i.isNotNull())
    c = F.transform(unravel_indices(at, (4, 4, 4)), lambda p: p[0] * 100 + p[1] * 10 + p[2])
    return vectors(s, d).select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]")).alias("codes"))


_Z = "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), z as (select vec_id, i, v[2 * i + 1] as re, v[2 * i + 2] as im, v[63 - 2 * i] as re2, v[64 - 2 * i] as im2 from e, unnest(range(32)) as u(i)) "


def complexes(s, d):
    return vectors(s, d).select("vec_id", C.interleaved(F.col("v")).alias("z"))


@query(_Z + "select vec_id, cast(i as int) as i, round(sqrt(re * re + im * im), 5) as size, round(re * re2 - im * im2, 5) as re, round(re * im2 + im * re2, 5) as im, round(-im, 5) as conj, round(sqrt(re * re + im * im + re2 * re2 + im2 * im2), 5) as rss from z")
def complex_arithmetic(s, d):
    """Absolute values, conjugates, products with the reversed array, and the root of the sum of squares of both."""
    x = complexes(s, d).withColumn("w", F.reverse("z"))
    z, w = F.col("z"), F.col("w")
    x = x.select("vec_id", F.posexplode(F.arrays_zip(C.absolute(z).alias("size"), C.multiply(z, w).alias("p"), C.conjugate(z).alias("c"), C.root_sum_of_squares(F.array(z, w)).alias("rss"))).alias("i", "r"))
    return x.select("vec_id", "i", *[F.round(c, 5).alias(n) for n, c in (("size", "r.size"), ("re", "r.p.re"), ("im", "r.p.im"), ("conj", "r.c.im"), ("rss", "r.rss"))])


@query(_Z + f"select vec_id, round(sum(case when {unit_sql("concat(vec_id, '/', i)", '3')} < (32 / 4.0 - 3) / 29 or i between 15 and 17 then sqrt(re * re + im * im) else 0 end), 5) as kept, count(*) filter (where {unit_sql("concat(vec_id, '/', i)", '3')} < (32 / 4.0 - 3) / 29 or i between 15 and 17) as columns from z group by 1")
def kspace_random_mask(s, d):
    x = complexes(s, d).withColumn("m", C.random_mask("vec_id", 32, 0.1, 4, 3))
    total = F.aggregate(C.absolute(C.masked(F.col("z"), F.col("m"))), F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", F.round(total, 5).alias("kept"), F.size(F.filter("m", lambda b: b)).cast("long").alias("columns"))


@query(f"with e as (select vec_id, cast(floor({unit_sql('vec_id', '3')} * 6) as int) as o from embeddings), k as (select vec_id, i from e, unnest(range(32)) as u(i) where i between 15 and 17 or exists (select 1 from range(8) t(n) where o + n * 5.8::double < 31 and i = round_even(o + n * 5.8::double, 0))) select vec_id, count(*) as columns, sum(i)::bigint as places from k group by 1")
def kspace_equispaced_mask(s, d):
    m = F.filter(F.transform(C.equispaced_mask("vec_id", 32, 0.1, 4, 3), lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    return vectors(s, d).select("vec_id", F.size(m).cast("long").alias("columns"), F.aggregate(m, F.lit(0).cast("long"), lambda a, b: a + b).alias("places"))


@query(_Z + ", f as (select a.vec_id, k, sum(b.re * cos(-2 * pi() * k * b.i / 32) - b.im * sin(-2 * pi() * k * b.i / 32)) / sqrt(32) as re, sum(b.re * sin(-2 * pi() * k * b.i / 32) + b.im * cos(-2 * pi() * k * b.i / 32)) / sqrt(32) as im from (select vec_id from e) a join z b using (vec_id), range(32) t(k) group by 1, 2) select vec_id, cast(k as int) as k, round(sqrt(re * re + im * im), 4) as size from f")
def fourier_transform(s, d):
    return complexes(s, d).select("vec_id", F.posexplode(C.absolute(C.dft(F.col("z")))).alias("k", "size")).withColumn("size", F.round("size", 4))


def _checked(name, made, value):
    """Register a query of signals (64 values) against SQL for the value at each place; sums weighted by the place, and one value."""

    @query(_E + f", w as (select vec_id, i, {value} as y from e) select vec_id, round(sum(y * (i + 1)), 4) as checksum, round(max(case when i = 21 then y end), 5) as at21 from w group by 1", name=name)
    def run(s, d):
        x = vectors(s, d).withColumn("y", made(F.col("v")))
        total = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        return x.select("vec_id", F.round(total, 4).alias("checksum"), F.round(F.col("y")[21], 5).alias("at21"))

    return run


_LEN = "cast(floor(({u} * 0.3 + 0.1) * 64) as int)"
_SEG = lambda seed: (_LEN.format(u=unit_sql("vec_id", f"{seed}len")), f"cast(floor({unit_sql('vec_id', f'{seed}at')} * (64 - {_LEN.format(u=unit_sql('vec_id', f'{seed}len'))} + 1)) as int)")
_IN = lambda seed: f"i >= {_SEG(seed)[1]} and i < {_SEG(seed)[1]} + {_SEG(seed)[0]}"
_checked("signal_scale", lambda a: S.rand_scale(a, "vec_id", -0.5, 0.5, 1), f"x + x * ({unit_sql('vec_id', '1')} - 0.5)")
_checked("signal_drop", lambda a: S.rand_drop(a, "vec_id", 0.1, 0.4, 2), f"case when {_IN(2)} then 0.0 else x end")
_checked("signal_noise", lambda a: S.rand_gaussian_noise(a, "vec_id", 0.001, 0.02, 3), f"x + ({unit_sql('vec_id', '3')} * 0.019 + 0.001) * sqrt(-2 * ln(1 - {unit_sql("concat(vec_id, '/', i)", '3u')})) * cos(2 * pi() * {unit_sql("concat(vec_id, '/', i)", '3v')})")
_checked("signal_add_sine", lambda a: S.rand_add(a, "vec_id", "sine", (0.1, 0.3), (0.001, 0.02), 4), f"x + ({unit_sql('vec_id', '4m')} * 0.2 + 0.1) * sin(({unit_sql('vec_id', '4f')} * 0.019 + 0.001) * i)")
_checked("signal_add_pulse_partial", lambda a: S.rand_add(a, "vec_id", "pulse", (0.1, 0.3), (0.1, 0.2), 5, (0.1, 0.4)), f"case when {_IN(5)} then x + ({unit_sql('vec_id', '5m')} * 0.2 + 0.1) * case when sin(({unit_sql('vec_id', '5f')} * 0.1 + 0.1) * (i - {_SEG(5)[1]})) >= 0 then 1.0 else -1.0 end else x end")
_checked("signal_add_sine_partial", lambda a: S.rand_add(a, "vec_id", "sine", (0.1, 0.3), (0.1, 0.2), 6, (0.1, 0.4)), f"case when {_IN(6)} then x + ({unit_sql('vec_id', '6m')} * 0.2 + 0.1) * sin(({unit_sql('vec_id', '6f')} * 0.1 + 0.1) * (i - {_SEG(6)[1]})) else x end")
_checked("signal_shift_filled", lambda a: S.rand_shift(a, "vec_id", -0.2, 0.2, "fill", -1.0, 7), f"coalesce((select b.x from e b where b.vec_id = e.vec_id and b.i = e.i - round_even(({unit_sql('e.vec_id', '7')} * 0.4 - 0.2) * 64, 0)), -1.0)")
_checked("signal_shift_wrapped", lambda a: S.rand_shift(a, "vec_id", -0.2, 0.2, "wrap", 0.0, 7), f"(select b.x from e b where b.vec_id = e.vec_id and b.i = (e.i - cast(round_even(({unit_sql('e.vec_id', '7')} * 0.4 - 0.2) * 64, 0) as int) + 64) % 64)")
_checked("signal_envelope", S.envelope, "sqrt(x * x + pow((select sum(b.x * 2 / 64 / tan(pi() * (e.i - b.i) / 64)) from e b where b.vec_id = e.vec_id and (e.i - b.i) % 2 <> 0), 2))")


_B, _A = S.notch(8.0, 5.0, 64.0)


@query("with recursive " + _E[5:-1] + f""", f as (select e.vec_id, e.i, {_B[0]!r}::double * e.x as y, 0.0::double as y1, e.x as x1, 0.0::double as x2 from e where i = 0 union all select f.vec_id, f.i + 1, {_B[0]!r} * e.x + {_B[1]!r} * f.x1 + {_B[2]!r} * f.x2 - ({_A[1]!r}) * f.y - ({_A[2]!r}) * f.y1, f.y, e.x, f.x1 from f join e on e.vec_id = f.vec_id and e.i = f.i + 1),
r as (select vec_id, 63 - i as i, y as x from f), g as (select r.vec_id, r.i, {_B[0]!r}::double * r.x as y, 0.0::double as y1, r.x as x1, 0.0::double as x2 from r where i = 0 union all select g.vec_id, g.i + 1, {_B[0]!r} * r.x + {_B[1]!r} * g.x1 + {_B[2]!r} * g.x2 - ({_A[1]!r}) * g.y - ({_A[2]!r}) * g.y1, g.y, r.x, g.x1 from g join r on r.vec_id = g.vec_id and r.i = g.i + 1)
select vec_id, round(sum(y * (64 - i)), 4) as checksum, round(max(case when i = 42 then y end), 5) as at21 from g group by 1""")
def signal_remove_frequency(s, d):
    x = vectors(s, d).withColumn("y", S.remove_frequency(F.col("v"), 8.0, 5.0, 64.0))
    total = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", F.round(total, 4).alias("checksum"), F.round(F.col("y")[21], 5).alias("at21"))


@query("select vec_id, label, coalesce(list_sum(list_filter(range(64), lambda i: embedding[i + 1] <= -0.1)), 0)::bigint as low, coalesce(list_sum(list_filter(range(64), lambda i: embedding[i + 1] > -0.1 and embedding[i + 1] <= 0.1)), 0)::bigint as middle, coalesce(list_sum(list_filter(range(64), lambda i: embedding[i + 1] > 0.1)), 0)::bigint as high from embeddings")
def classes_to_indices(s, d):
    """Positions of the cells of each of three classes; their sums."""
    x = vectors(s, d).withColumn("c", F.transform("v", lambda x: F.when(x <= single(-0.1), 0).when(x <= single(0.1), 1).otherwise(2)))
    places = lambda k: F.filter(F.transform("c", lambda c, i: F.when(c == k, i)), lambda i: i.isNotNull())
    at = [places(k) for k in range(3)]
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return x.select("vec_id", "label", *[add(a).alias(n) for a, n in zip(at, ("low", "middle", "high"), strict=True)])
