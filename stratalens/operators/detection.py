"""Box layouts, geometric transforms of boxes, box and mask conversion, regression codes, anchors and anchor matching.

Boxes are columns xmin, ymin, [zmin,] xmax, ymax[, zmax]; ``axes`` is "xy" or "xyz". Transforms give a
dictionary of columns for ``withColumns``. All but the matching of anchors stays in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.operators import boxes as B

# What stands at each place of an array of the layout.
LAYOUTS = {
    "xyxy": ("xmin", "ymin", "xmax", "ymax"),
    "xxyy": ("xmin", "xmax", "ymin", "ymax"),
    "xywh": ("xmin", "ymin", "xsize", "ysize"),
    "ccwh": ("xcenter", "ycenter", "xsize", "ysize"),
    "xyzxyz": ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"),
    "xxyyzz": ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax"),
    "xyxyzz": ("xmin", "ymin", "xmax", "ymax", "zmin", "zmax"),
    "xyzwhd": ("xmin", "ymin", "zmin", "xsize", "ysize", "zsize"),
    "cccwhd": ("xcenter", "ycenter", "zcenter", "xsize", "ysize", "zsize"),
}
MOST_LOG_SIZE = math.log(1000.0 / 16)


def spatial_axes(layout: str) -> str:
    """The axes of a layout, by its length."""
    return "xy" if len(LAYOUTS[layout]) == 4 else "xyz"


def corner(axis: str, side: str) -> Column:
    return F.col(f"{axis}{side}")


def from_layout(box: Column, layout: str) -> dict[str, Column]:
    """Corner columns from an array in a layout."""
    at = {name: box[i] for i, name in enumerate(LAYOUTS[layout])}
    out = {}
    for a in spatial_axes(layout):
        low = at[f"{a}min"] if f"{a}min" in at else at[f"{a}center"] - at[f"{a}size"] / 2
        out[f"{a}min"] = low
        out[f"{a}max"] = at[f"{a}max"] if f"{a}max" in at else low + at[f"{a}size"]
    return out


def to_layout(layout: str) -> Column:
    """An array in a layout from corner columns."""
    made = {"min": lambda a: corner(a, "min"), "max": lambda a: corner(a, "max"), "size": lambda a: corner(a, "max") - corner(a, "min"), "center": lambda a: (corner(a, "min") + corner(a, "max")) / 2}
    return F.array(*[made[name[1:]](name[0]) for name in LAYOUTS[layout]])


def convert_layout(box: Column, source: str, target: str, df: DataFrame, name: str) -> DataFrame:
    """The table with ``name`` as the box array in another layout of the same number of axes."""
    if len(LAYOUTS[source]) != len(LAYOUTS[target]):
        raise ValueError("the layouts differ in their number of axes")
    corners = {f"__{k}": v for k, v in from_layout(box, source).items()}
    held = df.withColumns(corners)
    renamed = {k[2:]: F.col(k) for k in corners}
    made = {"min": lambda a: renamed[f"{a}min"], "max": lambda a: renamed[f"{a}max"], "size": lambda a: renamed[f"{a}max"] - renamed[f"{a}min"], "center": lambda a: (renamed[f"{a}min"] + renamed[f"{a}max"]) / 2}
    return held.withColumn(name, F.array(*[made[x[1:]](x[0]) for x in LAYOUTS[target]])).drop(*corners)


def no_box_is_empty(box: Column) -> Column:
    """A missing box array as an empty one."""
    return F.coalesce(box, F.array().cast("array<double>"))


def is_valid(axes: str = "xy") -> Column:
    """Whether all corners are finite numbers and no extent is negative."""
    ok = []
    for a in axes:
        for s in ("min", "max"):
            c = corner(a, s)
            ok.append(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        ok.append(corner(a, "max") >= corner(a, "min"))
    return reduce(Column.__and__, ok)


def affine(matrix: Sequence[Sequence[float]], axes: str = "xy") -> dict[str, Column]:
    """Boxes whose two corners went through a homogeneous matrix: the least and greatest of each coordinate."""
    out = {}
    for i, a in enumerate(axes):
        ends = [reduce(Column.__add__, [corner(b, s) * float(matrix[i][j]) for j, b in enumerate(axes)]) + float(matrix[i][len(axes)]) for s in ("min", "max")]
        out[f"{a}min"], out[f"{a}max"] = F.least(*ends), F.greatest(*ends)
    return out


def inverse_affine(matrix: Sequence[Sequence[float]], axes: str = "xy") -> dict[str, Column]:
    """World boxes as boxes of the image that the matrix leads to the world."""
    import numpy as np

    return affine(np.linalg.inv(np.asarray(matrix, float)).tolist(), axes)


def zoom(factors: Sequence[float | Column], axes: str = "xy") -> dict[str, Column]:
    return {f"{a}{s}": corner(a, s) * (F.lit(float(z)) if isinstance(z, (int, float)) else z) for a, z in zip(axes, factors, strict=True) for s in ("min", "max")}


def resize(source: Sequence[float], target: Sequence[float], axes: str = "xy") -> dict[str, Column]:
    return zoom([t / s for s, t in zip(source, target, strict=True)], axes)


def flip(size: Sequence[float], flipped: str, axes: str = "xy", when: Column | None = None) -> dict[str, Column]:
    """Boxes mirrored along some axes of an image of a size; where ``when`` is false they stay."""
    out = {}
    for a, n in zip(axes, size, strict=True):
        if a in flipped:
            lo, hi = float(n) - corner(a, "max"), float(n) - corner(a, "min")
            out[f"{a}min"] = lo if when is None else F.when(when, lo).otherwise(corner(a, "min"))
            out[f"{a}max"] = hi if when is None else F.when(when, hi).otherwise(corner(a, "max"))
    return out


def swap_axes(a: str, b: str) -> dict[str, Column]:
    return {f"{x}{s}": corner(y, s) for x, y in ((a, b), (b, a)) for s in ("min", "max")}


def rotate90(size: Sequence[float], k: int = 1, plane: str = "xy", axes: str = "xy") -> dict[str, Column]:
    """Boxes in an image turned k times by 90 degrees in a plane, from its first towards its second axis."""
    a, b = plane
    na, nb = (float(size[axes.index(x)]) for x in plane)
    lo, hi = (lambda x: corner(x, "min")), (lambda x: corner(x, "max"))
    turned = {
        0: {a: (lo(a), hi(a)), b: (lo(b), hi(b))},
        1: {a: (nb - hi(b), nb - lo(b)), b: (lo(a), hi(a))},
        2: {a: (na - hi(a), na - lo(a)), b: (nb - hi(b), nb - lo(b))},
        3: {a: (lo(b), hi(b)), b: (na - hi(a), na - lo(a))},
    }[k % 4]
    return {f"{x}{s}": v for x, pair in turned.items() for s, v in zip(("min", "max"), pair, strict=True)}


def nonempty(axes: str = "xy") -> Column:
    """Whether every extent is a whole unit at least."""
    return reduce(Column.__and__, [corner(a, "max") >= corner(a, "min") + 1 for a in axes])


def clip_to_image(df: DataFrame, size: Sequence[float], axes: str = "xy", remove_empty: bool = True) -> DataFrame:
    out = df.withColumns(B.clip(axes, dict(zip(axes, size, strict=True))))
    return out.where(nonempty(axes)) if remove_empty else out


def crop(df: DataFrame, start: Sequence[float], end: Sequence[float], axes: str = "xy", remove_empty: bool = True) -> DataFrame:
    """Boxes as an image cropped to [start, end) shows them."""
    made = {}
    for a, lo, hi in zip(axes, start, end, strict=True):
        for s in ("min", "max"):
            made[f"{a}{s}"] = F.least(F.greatest(corner(a, s), F.lit(float(lo))), F.lit(float(hi))) - float(lo)
    out = df.withColumns(made)
    return out.where(nonempty(axes)) if remove_empty else out


def rand_zoom(df: DataFrame, key: str, lo: float, hi: float, probability: float, seed: int = 0, axes: str = "xy") -> DataFrame:
    """All boxes of a key zoomed by one drawn factor, with the given probability."""
    z = F.when(draws.happens(key, probability, seed), draws.between(key, lo, hi, seed)).otherwise(1.0)
    return df.withColumns(zoom([z] * len(axes), axes))


def rand_flip(df: DataFrame, key: str, size: Sequence[float], flipped: str, probability: float, seed: int = 0, axes: str = "xy") -> DataFrame:
    return df.withColumns(flip(size, flipped, axes, draws.happens(key, probability, seed)))


def rand_rotate90(df: DataFrame, key: str, size: Sequence[float], probability: float, most: int = 3, seed: int = 0, plane: str = "xy", axes: str = "xy") -> DataFrame:
    """Turns of all boxes of a key: with the given probability one to ``most`` times 90 degrees."""
    k = F.when(draws.happens(key, probability, seed), draws.below(key, most, seed) + 1).otherwise(0)
    made: dict[str, Column] = {}
    for turns in range(4):
        for name, c in rotate90(size, turns, plane, axes).items():
            made[name] = F.when(k == turns, c) if name not in made else made[name].when(k == turns, c)
    return df.withColumns(made)


def box_cells(df: DataFrame, axes: str = "xy") -> DataFrame:
    """One row for each cell inside a box (columns x, y[, z]); corners are cut to whole numbers. The cells of a box's mask that aren't background."""
    for a in axes:
        lo, hi = corner(a, "min").cast("int"), corner(a, "max").cast("int")
        df = df.where(hi > lo).withColumn(a, F.explode(F.sequence(lo, hi - 1)))
    return df


def masks_of_boxes(df: DataFrame, by: Sequence[str], axes: str = "xy") -> DataFrame:
    """(by, cells, xmin, xmax, ...): the number of different cells (see ``box_cells``) inside the boxes of each group, and the box around them, its end exclusive.

    Boxes move once. Cells meet 64 at a time, as the bits of a block of 8 x 8 or 4 x 4 x 4, so no cell is a row.
    """
    side = {1: 64, 2: 8, 3: 4}[len(axes)]
    ends = {f"{a}{s}": corner(a, s).cast("int") for a in axes for s in ("min", "max")}
    x = df.select(*by, *[c.alias(f"__{n}") for n, c in ends.items()])
    x = x.where(reduce(Column.__and__, [F.col(f"__{a}max") > F.col(f"__{a}min") for a in axes])).repartition(*by)
    for a in axes:
        lo, hi = F.col(f"__{a}min"), F.col(f"__{a}max")
        x = x.withColumn(f"__{a}", F.explode(F.sequence(F.floor(lo / side), F.floor((hi - 1) / side))))
    mask = None
    for k, a in enumerate(axes):
        # The bits of a block whose coordinate lies from one number to before another, for all such pairs.
        step = side ** (len(axes) - 1 - k)
        table = [_signed(sum(1 << bit for bit in range(64) if lo <= bit // step % side < hi)) for lo in range(side) for hi in range(1, side + 1)]
        base = F.col(f"__{a}") * side
        lo, hi = F.greatest(F.col(f"__{a}min") - base, F.lit(0)), F.least(F.col(f"__{a}max") - base, F.lit(side))
        bits = F.element_at(F.lit(table).cast("array<bigint>"), (lo * side + hi).cast("int"))
        mask = bits if mask is None else mask.bitwiseAND(bits)
    around = {f"{a}{s}": f(f"__{a}{s}").alias(f"__{a}{s}") for a in axes for s, f in (("min", F.min), ("max", F.max))}
    blocks = x.groupBy(*by, *[f"__{a}" for a in axes]).agg(F.bit_or(mask).alias("__bits"), *around.values())
    wide = [f(f"__{a}{s}").alias(f"{a}{s}") for a in axes for s, f in (("min", F.min), ("max", F.max))]
    return blocks.groupBy(*by).agg(F.sum(F.bit_count("__bits").cast("long")).alias("cells"), *wide)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def boxes_of_cells(cells: DataFrame, by: Sequence[str], label: str, axes: str = "xy") -> DataFrame:
    """The box around the cells of each group, its end exclusive, with the label of the first cell in row-major order."""
    ends = [x for a in axes for x in (F.min(a).alias(f"{a}min"), (F.max(a) + 1).alias(f"{a}max"))]
    return cells.groupBy(*by).agg(*ends, F.min_by(label, F.struct(*axes)).alias(label))


def select_labels(df: DataFrame, label: str, labels: Sequence[int]) -> DataFrame:
    return df.where(F.col(label).isin(list(labels)))


def _center(p: str, a: str) -> Column:
    return (F.col(f"{p}{a}min") + F.col(f"{p}{a}max")) / 2


def _size(p: str, a: str) -> Column:
    return F.col(f"{p}{a}max") - F.col(f"{p}{a}min")


def encode(box: str, reference: str, axes: str = "xy", weights: Sequence[float] | None = None) -> Column:
    """Regression targets of a box against a reference (column prefixes): offsets of the centre in units of the reference's size, then logarithms of the size ratios."""
    w = list(weights or [1.0] * (2 * len(axes)))
    centers = [(_center(box, a) - _center(reference, a)) / _size(reference, a) * w[i] for i, a in enumerate(axes)]
    sizes = [F.log(_size(box, a) / _size(reference, a)) * w[len(axes) + i] for i, a in enumerate(axes)]
    return F.array(*centers, *sizes)


def decode(code: Column, reference: str, axes: str = "xy", weights: Sequence[float] | None = None) -> dict[str, Column]:
    """The corners that a code gives against a reference; logarithms of sizes are held below ln(1000 / 16)."""
    n = len(axes)
    w = list(weights or [1.0] * (2 * n))
    out = {}
    for i, a in enumerate(axes):
        center = code[i] / w[i] * _size(reference, a) + _center(reference, a)
        half = F.exp(F.least(code[n + i] / w[n + i], F.lit(MOST_LOG_SIZE))) * _size(reference, a) / 2
        out[f"{a}min"], out[f"{a}max"] = center - half, center + half
    return out


def anchor_shapes(sizes: Sequence[float], ratios: Sequence[float | Sequence[float]]) -> list[tuple[float, ...]]:
    """Half extents of the anchors of one level, by ratio then size: extents 1 : r (: r2) whose product is the size's power; halves rounded half to even."""
    out = []
    for r in ratios:
        each = [1.0, float(r)] if isinstance(r, (int, float)) else [1.0, *map(float, r)]
        unit_size = math.prod(each) ** (1 / len(each))
        out += [tuple(float(round(e / unit_size * s / 2)) for e in each) for s in sizes]
    return out


def shaped_anchors(shapes: Sequence[Sequence[float]], scale: float = 1.0) -> list[tuple[float, ...]]:
    """Half extents of the anchors of one level from whole shapes and the level's scale."""
    return [tuple(float(round(scale * e / 2)) for e in s) for s in shapes]


def anchors(spark: SparkSession, grids: Sequence[Sequence[int]], strides: Sequence[Sequence[int]], halves: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """level, place (row-major in the level's grid), shape (number), i, j[, k] and corners of every anchor of every level; rows are made where they are used."""
    axes = "xyz"[: len(grids[0])]
    out = None
    for level, (grid, stride, half) in enumerate(zip(grids, strides, halves, strict=True)):
        place, left = F.col("place"), math.prod(grid)
        df = spark.range(left).withColumnRenamed("id", "place").select(F.lit(level).alias("level"), "place")
        for n, name in zip(grid, "ijk", strict=False):
            left //= n
            df = df.withColumn(name, (F.floor(place / left) % n).cast("int"))
        each = F.array(*[F.struct(F.lit(s).alias("shape"), *[F.lit(h).alias(f"half_{a}") for a, h in zip(axes, hs, strict=True)]) for s, hs in enumerate(half)])
        df = df.withColumn("s", F.explode(each))
        mid = {a: F.col(n) * float(st) for a, n, st in zip(axes, "ijk", stride, strict=False)}
        df = df.select("level", "place", "s.shape", *"ijk"[: len(axes)], *[(mid[a] + sign * F.col(f"s.half_{a}")).alias(f"{a}{s}") for s, sign in (("min", -1), ("max", 1)) for a in axes])
        out = df if out is None else out.unionByName(df)
    return out


def near_anchors(box: np.ndarray, of: np.ndarray, level: int, grid: Sequence[int], stride: Sequence[int], half: Sequence[Sequence[float]], candidates: int) -> tuple[np.ndarray, ...]:
    """(row of ``box``, level, place, shape, iou, whether the place lies in the box) of the candidates on one level of each group (``of``, ascending) of boxes.

    A place that comes r-th along one axis and s-th along the other has (r + 1)(s + 1) - 1 places before it, so few are looked at.
    """
    near, apart = [], []
    for a in range(2):
        mid = (box[:, a] + box[:, a + 2]) / 2
        first = np.clip(np.floor(np.nan_to_num(mid / stride[a]) + 0.5), 0, grid[a] - 1).astype(np.int64)
        at = first[:, None] + np.arange(-candidates, candidates + 1)
        away = np.where((at >= 0) & (at < grid[a]), (at * float(stride[a]) - mid[:, None]) ** 2, np.inf)
        order = np.argsort(away, axis=1, kind="stable")[:, :candidates]
        near.append(np.take_along_axis(at, order, axis=1))
        apart.append(np.take_along_axis(away, order, axis=1))
    r, s = np.array([(r, s) for r in range(candidates) for s in range(candidates) if (r + 1) * (s + 1) <= candidates]).T
    d = apart[0][:, r] + apart[1][:, s]
    i, j = near[0][:, r], near[1][:, s]
    row = np.repeat(np.arange(len(box)), len(r))
    d, i, j = d.ravel(), i.ravel(), j.ravel()
    ok = np.isfinite(d)
    row, d, i, j = row[ok], d[ok], i[ok], j[ok]
    place = i * grid[1] + j
    order = np.lexsort((place, d, of[row]))
    group = of[row[order]]
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.arange(len(group)) - np.repeat(begins, np.diff(begins, append=len(group)))
    order = order[rank < candidates]
    shape = np.tile(np.arange(len(half)), len(order))
    row, place, mid = (np.repeat(x, len(half), axis=0) for x in (row[order], place[order], np.stack([i[order] * float(stride[0]), j[order] * float(stride[1])], axis=1)))
    reach = np.asarray(half, float)[shape]
    mine = box[row]
    size = np.clip(mine[:, 2:] - mine[:, :2], 0, None).prod(axis=1)
    common = np.clip(np.minimum(mine[:, 2:], mid + reach) - np.maximum(mine[:, :2], mid - reach), 0, None).prod(axis=1)
    iou = common / (size + (2 * reach).prod(axis=1) - common + B.EPS)
    inside = ((mid > mine[:, :2] + 0.01) & (mid < mine[:, 2:] - 0.01)).all(axis=1)
    return row, np.full(len(row), level), place, shape, iou, inside


def match_anchors(boxes: DataFrame, by: Sequence[str], key: str, grids: Sequence[Sequence[int]], strides: Sequence[Sequence[int]], halves: Sequence[Sequence[Sequence[float]]], candidates: int = 4, center_in_box: bool = True) -> DataFrame:
    """``by``, level, place, shape, ``key``, iou: the box that each positive anchor of an image is matched with, by adaptive selection of training samples (2-D).

    Of each level the ``candidates`` nearest places of the grid, with all their shapes, are a box's
    candidates; those whose overlap is at least the mean plus the deviation of the overlaps of all its
    candidates, and whose centre lies in the box, are positive. An anchor of several boxes goes to the one
    it overlaps most. Near places are found from the box's centre, so boxes never meet all anchors. Places
    of equal distance come in row-major order. Rows of one image and ``key`` share their candidates; boxes
    without all four corners match nothing. Boxes move once, and then only positive anchors.
    """
    sides = [corner(a, s) for s in ("min", "max") for a in "xy"]
    rows = boxes.select(*by, key, *[c.cast("double").alias(f"__{i}") for i, c in enumerate(sides)]).dropna(subset=[f"__{i}" for i in range(4)])
    rows = rows.repartition(*by, key).sortWithinPartitions(*by, key)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in B.sorted_groups(it, [*by, key]):
            box = np.stack([table.column(f"__{i}").to_numpy() for i in range(4)], axis=1)
            of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            found = [np.concatenate(x) for x in zip(*[near_anchors(box, of, level, grid, stride, half, candidates) for level, (grid, stride, half) in enumerate(zip(grids, strides, halves, strict=True))], strict=True)]
            row, level, place, shape, iou, inside = found
            group = of[row]
            n = np.bincount(group, minlength=len(ends))
            mean = np.bincount(group, iou, len(ends)) / np.maximum(n, 1)
            least = mean + np.sqrt(np.bincount(group, (iou - mean[group]) ** 2, len(ends)) / np.maximum(n - 1, 1))
            keep = iou >= least[group]
            if center_in_box:
                keep &= inside
            taken = table.select([*by, key]).take(pa.array(row[keep])).combine_chunks()
            made = {"level": pa.array(level[keep].astype(np.int32)), "place": pa.array(place[keep]), "shape": pa.array(shape[keep].astype(np.int32)), "iou": pa.array(iou[keep])}
            for name, column in made.items():
                taken = taken.append_column(name, column)
            yield from taken.to_batches()

    schema = rows.select(*by, key, F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("shape"), F.lit(0.0).alias("iou")).schema
    x = rows.mapInArrow(run, schema)
    best = F.max_by(F.struct(F.col(key), "iou"), F.struct("iou", -F.col(key))).alias("b")
    return x.groupBy(*by, "level", "place", "shape").agg(best).select(*by, "level", "place", "shape", F.col(f"b.{key}").alias(key), F.col("b.iou").alias("iou"))


def points_of_boxes(axes: str = "xy") -> Column:
    """The corners of a box as an array of points, the first axis slowest."""
    out: list[list[Column]] = [[]]
    for a in axes:
        out = [[*p, corner(a, s)] for p in out for s in ("min", "max")]
    return F.array(*[F.array(*p) for p in out])


def boxes_of_points(points: Column, axes: str = "xy") -> dict[str, Column]:
    """The box around an array of points."""
    at = lambda i: F.transform(points, lambda p: p[i])
    return {f"{a}{s}": (F.array_min if s == "min" else F.array_max)(at(i)) for i, a in enumerate(axes) for s in ("min", "max")}


def rand_crop_by_box(df: DataFrame, key: str, box: str, size: Sequence[int], image: Sequence[int], seed: int = 0, axes: str = "xy") -> DataFrame:
    """Boxes as a crop of their image shows them, the crop about the centre of one drawn box of the image and inside it."""
    mid = [((corner(a, "min") + corner(a, "max")) / 2).alias(a) for a in axes]
    drawn = df.groupBy(key).agg(F.min_by(F.struct(*mid), F.struct(draws.unit(F.concat_ws("/", F.col(key), F.col(box)), seed), F.col(box), *mid)).alias("__mid"))
    out = df.join(drawn, key)
    for a, k, n in zip(axes, size, image, strict=True):
        start = F.least(F.greatest(F.floor(F.col(f"__mid.{a}")) - k // 2, F.lit(0)), F.lit(n - k))
        out = out.withColumn(f"__{a}", start)
    made = {f"{a}{s}": F.least(F.greatest(corner(a, s) - F.col(f"__{a}"), F.lit(0.0)), F.lit(float(k))) for a, k in zip(axes, size, strict=True) for s in ("min", "max")}
    return out.withColumns(made).where(nonempty(axes)).drop("__mid", *[f"__{a}" for a in axes])
