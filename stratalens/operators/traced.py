"""Spatial steps that leave a trace, their inverse, and lazy chains of them.

Rows hold an array (``data``, row-major), its ``shape`` and a ``trace``: what each step has done to this very
row, as (step, matrix, before): the matrix takes cells of the result to cells of what the
step was given, which had the shape ``before``.
A step draws from seed and the row's key, so draws differ from row to row and repeat exactly.

- ``apply`` runs steps one by one (nearest cells), each with its own gather.
- ``apply_lazily`` composes the steps' matrices first and gathers once, nearest or linear; a crop with a
  pad behind it then shows the cells that the crop had cut off, where step by step they are filled.
- ``invert`` reads a trace backwards and restores the array's place and shape; cells that a crop cut off are ``fill``.
  The trace may come from another row, so a prediction goes back onto the image that it was made for (``invert_with``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.functions import resampling as R

TRACE = "array<struct<step:string,matrix:array<double>,before:array<int>>>"

#: Of (shape column, dims, key): (matrix, new shape).
Step = tuple[str, Callable[[Column, int, Column], tuple[Column, Column]]]


def _diagonal(scale: Sequence[Column | float], shift: Sequence[Column | float]) -> Column:
    d = len(scale)
    return R.matrix([[*[scale[i] if i == j else 0.0 for j in range(d)], shift[i]] for i in range(d)])


def flip(probability: float = 0.5, seed: int = 0, axes: Sequence[int] | None = None) -> Step:
    """Each axis mirrored with the given probability, drawn for each axis."""

    def made(n, d, key):
        hit = [draws.unit(key, seed, f"a{k}") < (probability if axes is None or k in axes else 0.0) for k in range(d)]
        return _diagonal([F.when(h, -1.0).otherwise(1.0) for h in hit], [F.when(h, n[k] - 1).otherwise(0) for k, h in enumerate(hit)]), n

    return "flip", made


def rotate90(most: int = 3, seed: int = 0, axes: tuple[int, int] = (0, 1)) -> Step:
    """0 to ``most`` turns by 90 degrees from the first towards the second axis."""

    def made(n, d, key):
        a, b = axes
        k = draws.below(key, most + 1, seed)
        rows, shapes = [], []
        # One turn: cell (i, j) of the result is cell (j, n_b - 1 - i) of what was given; more of them likewise.
        turned = {0: (a, 1, 0, b, 1, 0), 1: (b, 1, 0, a, -1, n[b] - 1), 2: (a, -1, n[a] - 1, b, -1, n[b] - 1), 3: (b, -1, n[a] - 1, a, 1, 0)}
        for times, (ja, sa, oa, jb, sb, ob) in turned.items():
            full = [[float(i == j) for j in range(d)] + [0.0] for i in range(d)]
            full[a] = [float(sa) if j == ja else 0.0 for j in range(d)] + [oa]
            full[b] = [float(sb) if j == jb else 0.0 for j in range(d)] + [ob]
            rows.append(R.matrix(full))
            size = [n[i] for i in range(d)]
            if times % 2:
                size[a], size[b] = n[b], n[a]
            shapes.append(F.array(*size))
        pick = lambda xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
        return pick(rows), pick(shapes)

    return "rotate90", made


def crop(size: Sequence[int], seed: int = 0) -> Step:
    """A window of a size (the whole axis where it is shorter) at a drawn place."""

    def made(n, d, key):
        new = [F.least(F.lit(s), n[k]) for k, s in enumerate(size)]
        start = [draws.below(key, n[k] - new[k] + 1, seed, f"c{k}") for k in range(d)]
        return _diagonal([1.0] * d, start), F.array(*new)

    return "crop", made


def pad(most: int, seed: int = 0) -> Step:
    """0 to ``most`` cells at each end of each axis."""

    def made(n, d, key):
        lo = [draws.below(key, most + 1, seed, f"l{k}") for k in range(d)]
        hi = [draws.below(key, most + 1, seed, f"h{k}") for k in range(d)]
        return _diagonal([1.0] * d, [-x for x in lo]), F.array(*[n[k] + lo[k] + hi[k] for k in range(d)])

    return "pad", made


def zoom(low: float, high: float, seed: int = 0) -> Step:
    """A drawn factor for all axes; cells keep their middles' places."""

    def made(n, d, key):
        factor = draws.between(key, low, high, seed, "z")
        new = [F.greatest(F.lit(1), F.floor(n[k] * factor + 0.5).cast("int")) for k in range(d)]
        return _diagonal([n[k] / new[k] for k in range(d)], [n[k] / new[k] / 2 - 0.5 for k in range(d)]), F.array(*new)

    return "zoom", made


def rotate(low: float, high: float, seed: int = 0) -> Step:
    """A plane turned about its middle by a drawn angle (radians); the shape stays."""

    def made(n, d, key):
        if d != 2:
            raise ValueError("rotate turns planes")
        t = draws.between(key, low, high, seed, "r")
        mid = [(n[k] - 1) / 2 for k in range(2)]
        c, s = F.cos(t), F.sin(t)
        return R.matrix([[c, -s, mid[0] - c * mid[0] + s * mid[1]], [s, c, mid[1] - s * mid[0] - c * mid[1]]]), n

    return "rotate", made


def translate(shift: Sequence[float]) -> Step:
    """Moved by so many cells; the shape stays."""
    return "translate", lambda n, d, key: (_diagonal([1.0] * d, [-float(x) for x in shift]), n)


def some(step: Step, probability: float, seed: int = 0) -> Step:
    """A step for a part of the rows, as each draws; others keep their arrays, and their trace says so by an identity."""
    name, inner = step

    def made(n, d, key):
        m, new = inner(n, d, key)
        hit = draws.happens(key, probability, seed, "some")
        return F.when(hit, m).otherwise(R.identity(d)), F.when(hit, new).otherwise(n)

    return name, made


def _columns(df: DataFrame, trace: str) -> DataFrame:
    return df if trace in df.columns else df.withColumn(trace, F.array().cast(TRACE))


def apply(df: DataFrame, steps: Sequence[Step], key: Column | str, dims: int, data: str = "data", shape: str = "shape", trace: str = "trace", fill: float = 0.0) -> DataFrame:
    """The rows after the steps, each step noted in ``trace``."""
    key = F.col(key) if isinstance(key, str) else key
    df = _columns(df, trace)
    for name, made in steps:
        m, new = made(F.col(shape), dims, key)
        df = df.withColumns({"__m": m, "__n": new.cast("array<int>")})
        df = df.withColumn(data, R.gather_rows(F.col(data), F.col(shape), F.col("__m"), F.col("__n"), dims, fill))
        df = df.withColumn(trace, F.concat(trace, F.array(F.struct(F.lit(name).alias("step"), F.col("__m").alias("matrix"), F.col(shape).cast("array<int>").alias("before")))))
        df = df.withColumn(shape, F.col("__n")).drop("__m", "__n")
    return df


def apply_lazily(df: DataFrame, steps: Sequence[Step], key: Column | str, dims: int, mode: str = "nearest", data: str = "data", shape: str = "shape", trace: str = "trace", fill: float = 0.0, displacement: Column | None = None) -> DataFrame:
    """The rows after the steps by one gather over the product of their matrices; the trace holds one entry."""
    key = F.col(key) if isinstance(key, str) else key
    df = _columns(df, trace).withColumns({"__m": R.identity(dims), "__n": F.col(shape).cast("array<int>")})
    for _, made in steps:
        m, new = made(F.col("__n"), dims, key)
        df = df.withColumns({"__s": m, "__t": new.cast("array<int>")}).withColumns({"__m": R.compose(F.col("__m"), F.col("__s"), dims), "__n": F.col("__t")}).drop("__s", "__t")
    entry = F.struct(F.lit("+".join(n for n, _ in steps)).alias("step"), F.col("__m").alias("matrix"), F.col(shape).cast("array<int>").alias("before"))
    made = R.gather(F.col(data), F.col(shape), F.col("__m"), F.col("__n"), dims, mode, fill, displacement=displacement)
    return df.withColumns({data: made, trace: F.concat(trace, F.array(entry)), shape: F.col("__n")}).drop("__m", "__n")


def restored(data: Column, shape: Column, trace: Column, dims: int, fill: float = 0.0) -> Column:
    """(data, shape) as a struct before all steps of a trace."""
    made = R.restore(data, shape, F.transform(trace, lambda t: t["matrix"]), F.transform(trace, lambda t: t["before"]), dims, fill)
    return F.struct(made.alias("data"), F.coalesce(F.get(trace, 0)["before"], shape.cast("array<int>")).alias("shape"))


def invert(df: DataFrame, dims: int, data: str = "data", shape: str = "shape", trace: str = "trace", fill: float = 0.0) -> DataFrame:
    """The rows put back to where they were before the steps of their own trace, which is empty then."""
    df = df.withColumn("__r", restored(F.col(data), F.col(shape), F.col(trace), dims, fill))
    return df.withColumns({data: F.col("__r.data"), shape: F.col("__r.shape"), trace: F.array().cast(TRACE)}).drop("__r")


def invert_with(df: DataFrame, images: DataFrame, on: Sequence[str], dims: int, data: str = "data", shape: str = "shape", trace: str = "trace", fill: float = 0.0) -> DataFrame:
    """Rows made from transformed images (predictions, masks) put back by the images' traces; a row without its image is kept as it is."""
    found = images.select(*on, F.col(trace).alias("__trace"))
    df = df.drop(trace).join(found, list(on), "left").withColumn("__trace", F.coalesce("__trace", F.array().cast(TRACE)))
    return invert(df, dims, data, shape, "__trace", fill).drop("__trace")

