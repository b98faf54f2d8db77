"""Images of any size as tables of cells: components, floods and morphology across tiles.

A cell is a row of image columns (``by``) and whole coordinates (``at``, from 0; below 2^31 in a plane, 2^20 in
space); a cell without a row is outside the mask. Work that needs a neighbourhood runs in tiles of ``tile``
cells a side, so a task holds one tile; what crosses borders between tiles meets in Spark rounds that move
border cells alone. Results don't depend on the tiles.

Cells of null coordinates are dropped; repeated cells count once. ``connectivity`` k joins cells that differ by one in up to k coordinates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.storage import forget, written

TILE = 64


def offsets(dims: int, connectivity: int) -> list[tuple[int, ...]]:
    return [o for o in product((-1, 0, 1), repeat=dims) if 0 < sum(map(abs, o)) <= connectivity]


def disk(radius: int, dims: int = 2) -> list[tuple[int, ...]]:
    return [o for o in product(range(-radius, radius + 1), repeat=dims) if sum(x * x for x in o) <= radius * radius]


def _met(df: DataFrame) -> DataFrame:
    """The side of a join that is met where its rows are: written tables look small in their files, and to broadcast them every round sends them through the driver."""
    return df.hint("merge")


def _bits(dims: int) -> int:
    return 62 // dims


def place(at: Sequence[str]) -> Column:
    """A cell's number in row-major order."""
    b = _bits(len(at))
    return reduce(lambda acc, c: F.shiftleft(acc, b) + F.col(c).cast("long"), at[1:], F.col(at[0]).cast("long"))


def _moved(cells: DataFrame, by: Sequence[str], at: Sequence[str], steps: Sequence[tuple[int, ...]], *keep: str) -> DataFrame:
    """Each cell at each of its neighbours' coordinates."""
    table = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(o)]) for o in steps])
    x = cells.withColumn("__s", F.explode(table))
    return x.select(*by, *[(F.col(c) + F.col(f"__s.d{k}")).alias(c) for k, c in enumerate(at)], *keep)


def _tile_of(at: Sequence[str], tile: int) -> list[Column]:
    return [F.floor(F.col(c) / tile).cast("int").alias(f"__t{k}") for k, c in enumerate(at)]


def _packed(cells: DataFrame, by: Sequence[str], at: Sequence[str], tile: int, *values: str) -> DataFrame:
    """A row for each tile: its cells by place."""
    dims = len(at)
    rows = cells.select(*by, *_tile_of(at, tile), F.struct(place(at).alias("p"), *values).alias("c"))
    return rows.groupBy(*by, *[f"__t{k}" for k in range(dims)]).agg(F.sort_array(F.collect_list("c")).alias("cells"))  # tile^dims cells at most


def _coordinates(places: np.ndarray, dims: int) -> np.ndarray:
    b = _bits(dims)
    return np.stack([places >> (b * (dims - 1 - k)) & ((1 << b) - 1) for k in range(dims)], axis=1)


def _step(o: Sequence[int], dims: int) -> int:
    return sum(x << (_bits(dims) * (dims - 1 - k)) for k, x in enumerate(o))


def least_places(places: np.ndarray, values: np.ndarray | None, dims: int, steps: Sequence[tuple[int, ...]]) -> np.ndarray:
    """For each cell (sorted by place) the least place in its component; cells of different values are apart."""
    label = np.arange(len(places))
    links = []
    at = _coordinates(places, dims)
    for o in steps:
        if o < (0,) * dims:
            continue
        inside = ((at + np.array(o)) >= 0).all(axis=1)
        to = np.searchsorted(places, places + _step(o, dims))
        ok = inside & (to < len(places))
        ok[ok] = places[to[ok]] == places[ok] + _step(o, dims)
        if values is not None:
            ok[ok] = values[to[ok]] == values[ok]
        links.append((np.flatnonzero(ok), to[ok]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (label[:0], label[:0])
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            return places[label]


def linked(links: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, node, component): the least node that each node of the links (by, a, b) reaches, by alternating rounds of large and small stars, each written."""
    by = list(by)
    e = written(links.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        large = both.join(_met(low), [*by, "u"]).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(_met(low), [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*by, "u", F.col("m").alias("v"))).distinct()
        before, seen = e, now
        e = written(small, "links")
        forget(before)
    return e.select(*by, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _placed(cells: DataFrame, by: Sequence[str], at: Sequence[str], *keep: str) -> DataFrame:
    """Cells of whole coordinates; repeated ones are left to the tiles, where they meet anyway."""
    return cells.dropna(subset=list(at)).select(*by, *[F.col(c).cast("long").alias(c) for c in at], *keep)


def _clean(cells: DataFrame, by: Sequence[str], at: Sequence[str], *keep: str) -> DataFrame:
    return _placed(cells, by, at, *keep).dropDuplicates([*by, *at])


def components(cells: DataFrame, by: Sequence[str], at: Sequence[str], value: str | None = None, connectivity: int = 1, tile: int = TILE) -> DataFrame:
    """(by, at, [value], component): the place of the first cell, row by row, of each cell's component. With ``value`` only cells of one value belong together."""
    dims, steps = len(at), offsets(len(at), connectivity)
    kept = [value] if value else []
    rows = _placed(cells, by, at, *kept)
    if value:
        rows = rows.withColumn("__v", F.xxhash64(value))
    else:
        rows = rows.withColumn("__v", F.lit(0).cast("long"))
    packed = _packed(rows, by, at, tile, "__v", *kept)
    kinds = dict(packed.dtypes)
    own = f"array<struct<p:bigint,label:bigint{''.join(f',{c}:{dict(rows.dtypes)[c]}' for c in kept)}>>"

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column("cells")
            flat, off = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            p = np.asarray(flat.field("p"))
            first = np.ones(len(p), bool)  # of repeated cells, which stand side by side
            first[1:] = p[1:] != p[:-1]
            first[off[:-1]] = True
            flat, off = flat.filter(pa.array(first)), np.concatenate([[0], np.cumsum(first)])[off]
            p, v = np.asarray(flat.field("p")), np.asarray(flat.field("__v"))
            out = np.zeros(len(p), np.int64)
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                out[i:j] = least_places(p[i:j], v[i:j], dims, steps)
            made = pa.StructArray.from_arrays([flat.field("p"), pa.array(out), *(flat.field(c) for c in kept)], ["p", "label", *kept])
            cols = [c for c in batch.schema.names if c != "cells"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), made)], [*cols, "cells"])

    names = [*by, *[f"__t{k}" for k in range(dims)]]
    labelled = packed.mapInArrow(label, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"cells {own}"]))
    b = _bits(dims)
    back = [F.shiftright("c.p", b * (dims - 1 - k)).bitwiseAND((1 << b) - 1).alias(c) for k, c in enumerate(at)]
    labelled = written(labelled.select(*by, F.explode("cells").alias("c")).select(*by, *back, F.col("c.label").alias("label"), *[F.col(f"c.{c}").alias(c) for c in kept]), "labels")
    # Links over tile borders: only cells that have a neighbour in another tile move.
    half = [o for o in steps if o > (0,) * dims]
    edge = reduce(Column.__or__, [(F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1) for c in at])
    border = labelled.where(edge)
    there = border.select(*by, *at, F.col("label").alias("b"), *[F.col(c).alias(f"__o_{c}") for c in kept])
    near = _moved(border.withColumnRenamed("label", "a"), by, at, half, "a", *kept)
    near = near.join(_met(there), [*by, *at])
    if value:
        near = near.where(F.col(value).eqNullSafe(F.col(f"__o_{value}")))
    found = linked(near.select(*by, "a", "b"), by)
    out = labelled.join(_met(found.withColumnRenamed("node", "label")), [*by, "label"], "left")
    return out.select(*by, *at, *kept, F.coalesce("component", "label").alias("component"))


def drop_small(labelled: DataFrame, by: Sequence[str], label: str, least: int) -> DataFrame:
    """Cells of components of at least so many cells."""
    sizes = labelled.groupBy(*by, label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return labelled.join(_met(sizes), [*by, label], "left_semi")


def with_points(labelled: DataFrame, points: DataFrame, by: Sequence[str], at: Sequence[str], label: str = "component", positive: str | None = None) -> DataFrame:
    """Cells of the components that hold a point (a positive one, if the points have signs); an image without points keeps nothing."""
    some = points.where(F.col(positive)) if positive else points
    hit = labelled.join(some.select(*by, *[F.col(c).cast("long").alias(c) for c in at]).distinct(), [*by, *at], "left_semi").select(*by, label).distinct()
    return labelled.join(hit, [*by, label], "left_semi")


def merge_with_points(positive: DataFrame, negative: DataFrame, points: DataFrame, by: Sequence[str], at: Sequence[str], sign: str, connectivity: int = 1, tile: int = TILE) -> DataFrame:
    """Corrections of a mask by points, as (by, at, keep): regions of ``positive`` that hold a positive point are to be added (true), regions of ``negative`` that hold a negative one removed (false)."""
    parts = []
    for cells, keep, which in ((positive, True, F.col(sign)), (negative, False, ~F.col(sign))):
        found = components(cells, by, at, connectivity=connectivity, tile=tile)
        parts.append(with_points(found, points.where(which), by, at).select(*by, *at, F.lit(keep).alias("keep")))
    return parts[0].unionByName(parts[1])


def erode(cells: DataFrame, by: Sequence[str], at: Sequence[str], steps: Sequence[tuple[int, ...]]) -> DataFrame:
    """Cells all of whose neighbours at the steps are there too; counts combine before they move."""
    cells = _clean(cells, by, at)
    back = [tuple(-x for x in o) for o in steps]
    whole = _moved(cells, by, at, back).groupBy(*by, *at).agg(F.count("*").alias("__n")).where(F.col("__n") == len(steps))
    return whole.drop("__n")


def dilate(cells: DataFrame, by: Sequence[str], at: Sequence[str], steps: Sequence[tuple[int, ...]]) -> DataFrame:
    return _moved(_clean(cells, by, at), by, at, steps).distinct()


def _windowed(cells: DataFrame, by: Sequence[str], at: Sequence[str], reach: int, tile: int, make, value: str | None = None) -> DataFrame:
    """(by, at, [value]) of what ``make`` keeps of each tile's own cells. A cell moves once to its tile and to those that it lies within ``reach`` of;
    ``make(there, own, values)`` gets dense boxes of a tile and its surroundings and returns (mask of kept cells, their values)."""
    dims, side, tiles = len(at), tile + 2 * reach, [f"__t{k}" for k in range(len(at))]
    box, inner = (side,) * dims, (slice(reach, reach + tile),) * dims
    rows = cells
    for c, t in zip(at, tiles, strict=True):
        near = F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
        rows = rows.withColumn(t, F.explode(near))
    place = reduce(lambda acc, x: acc * side + x, [F.col(c) - F.col(t) * tile + reach for c, t in zip(at, tiles, strict=True)])
    rows = rows.select(*by, *tiles, F.struct(place.cast("int").alias("p"), *([F.col(value).cast("double").alias("v")] if value else [])).alias("c"))
    packed = rows.groupBy(*by, *tiles).agg(F.collect_list("c").alias("cells"))  # side^dims cells at most
    kinds, keys = dict(packed.dtypes), [*by, *tiles]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                flat = batch.column("cells")[i].values
                p = np.asarray(flat.field("p"))
                there, own, values = np.zeros(box, bool), np.zeros(box, bool), None
                there.reshape(-1)[p] = True
                own[inner] = there[inner]
                if value:
                    values = np.zeros(box)
                    known = flat.field("v")
                    values.reshape(-1)[p] = np.asarray(known.fill_null(0.0))
                    there.reshape(-1)[p] = np.asarray(known.is_valid())
                if not own.any():
                    continue
                keep, made = make(there, own, values)
                found = np.argwhere(keep)
                first = [batch.column(t)[i].as_py() * tile - reach for t in tiles]
                cols = [pa.array([batch.column(c)[i].as_py()] * len(found), batch.schema.field(c).type) for c in by]
                cols += [pa.array(found[:, k] + first[k], pa.int64()) for k in range(dims)]
                yield pa.RecordBatch.from_arrays([*cols, *([made] if value else [])], [*by, *at, *([value] if value else [])])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"`{c}` long" for c in at), *([f"`{value}` double"] if value else [])])
    return packed.select(*keys, "cells").mapInArrow(run, schema)


def _shifted(box: np.ndarray, o: Sequence[int]) -> np.ndarray:
    """The box whose cell p is the cell p + o of ``box``, empty beyond its ends."""
    out = np.zeros_like(box)
    if all(abs(x) < n for x, n in zip(o, box.shape, strict=True)):
        out[tuple(slice(max(0, -x), n - max(0, x)) for x, n in zip(o, box.shape, strict=True))] = box[tuple(slice(max(0, x), n - max(0, -x)) for x, n in zip(o, box.shape, strict=True))]
    return out


def opened(cells: DataFrame, by: Sequence[str], at: Sequence[str], radius: int, tile: int = TILE) -> DataFrame:
    """Eroded and dilated by a ball. Only cells of the input can be left, so each tile settles its own."""
    ball = disk(radius, len(at))

    def make(there: np.ndarray, own: np.ndarray, values: None) -> tuple[np.ndarray, None]:
        whole = np.logical_and.reduce([_shifted(there, o) for o in ball])
        return np.logical_or.reduce([_shifted(whole, o) for o in ball]) & own, None

    return _windowed(_placed(cells, by, at), list(by), at, 2 * radius, tile, make)


def fill_holes(cells: DataFrame, grid: DataFrame, by: Sequence[str], at: Sequence[str], connectivity: int = 1, tile: int = TILE) -> DataFrame:
    """The cells and the holes in them: components of the rest of the grid that don't touch the grid's ends."""
    cells, grid = _clean(cells, by, at), _clean(grid, by, at)
    rest = written(components(grid.join(_met(cells), [*by, *at], "left_anti"), by, at, connectivity=connectivity, tile=tile), "rest")
    ends = grid.groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in at for n, f in (("lo", F.min), ("hi", F.max))])
    touch = reduce(Column.__or__, [(F.col(c) == F.col(f"__lo_{c}")) | (F.col(c) == F.col(f"__hi_{c}")) for c in at])
    open_ = rest.join(ends, list(by)).where(touch).select(*by, "component").distinct()
    return cells.unionByName(rest.join(open_, [*by, "component"], "left_anti").select(*by, *at))


def smooth(cells: DataFrame, by: Sequence[str], at: Sequence[str], value: str, weights: Sequence[float], tile: int = TILE) -> DataFrame:
    """Values weighted over neighbours, axis by axis, zero where there is no cell; the cells stay the same. Null values count as none; among nulls alone a cell stays null."""
    r, dims = len(weights) // 2, len(at)

    def make(there: np.ndarray, own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        for k in range(dims):
            to = [[-(j - r) if a == k else 0 for a in range(dims)] for j in range(len(weights))]
            values = sum(_shifted(values, o) * float(w) for o, w in zip(to, weights, strict=True))
            there = np.logical_or.reduce([_shifted(there, o) for o in to])
        return own, pa.array(values[own], pa.float64(), mask=~there[own])

    return _windowed(_placed(cells, by, at, value), list(by), at, max(r, len(weights) - 1 - r), tile, make, value)


def flood(places: np.ndarray, height: np.ndarray, marker: np.ndarray, dims: int, steps: Sequence[tuple[int, ...]], halo: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, steps on that level, label) of each cell by priority flood; label 0 where no marker reaches. ``halo``: (place, level, steps, label) of cells around."""
    b = _bits(dims)
    moves = [_step(o, dims) for o in steps]
    index = {p: i for i, p in enumerate(places.tolist())}
    heights, fixed = height.tolist(), (marker != 0).tolist()
    cost: list = [None] * len(places)
    label = marker.tolist()
    heap: list = []
    mask = (1 << b) - 1

    def spread(p: int, level: float, n: int, name: int) -> None:
        for o, move in zip(steps, moves, strict=True):
            if any((p >> (b * (dims - 1 - k)) & mask) + x < 0 for k, x in enumerate(o)):
                continue
            i = index.get(p + move)
            if i is None or fixed[i]:
                continue
            new = (heights[i], 0) if heights[i] > level else (level, n + 1)
            old = cost[i]
            if old is None or new < old:
                cost[i], label[i] = new, name
                heapq.heappush(heap, (*new, i))
            elif new == old and name < label[i]:
                label[i] = name

    order = places.tolist()
    for i, m in enumerate(fixed):
        if m:
            cost[i] = (heights[i], 0)
            heapq.heappush(heap, (heights[i], 0, i))
    for p, level, n, name in halo:
        spread(p, level, n, name)
    while heap:
        level, n, i = heapq.heappop(heap)
        if (level, n) == cost[i]:  # else it was reached at a lower cost since
            spread(order[i], level, n, label[i])
    levels = np.array([c[0] if c else np.inf for c in cost], float)
    return levels, np.array([c[1] if c else 0 for c in cost], np.int64), np.array(label, np.int64)


def watershed(cells: DataFrame, by: Sequence[str], at: Sequence[str], height: str, marker: str, connectivity: int = 1, tile: int = TILE) -> DataFrame:
    """(by, at, label): each cell with the marker that floods it, 0 if none does. ``marker`` is 0 or null where there is none; cells without a row are walls.

    Water rises from the markers. A cell is flooded at the lowest possible level (the least greatest height on a
    way from a marker), after the fewest steps on that level, and takes the label of the neighbours
    from which it is so reached, the least one if they differ. That is one result, whatever the order of work: a
    tile floods itself, given the cells around it, and tiles whose surroundings changed do so again.
    Between rounds only tiles' border cells move.
    """
    dims, steps = len(at), offsets(len(at), connectivity)
    by = list(by)
    tiles = [f"__t{k}" for k in range(dims)]
    rows = cells.withColumns({"__h": F.col(height).cast("double"), "__m": F.coalesce(F.col(marker).cast("long"), F.lit(0))})
    packed = written(_packed(_clean(rows, by, at, "__h", "__m").dropna(subset=["__h"]), by, at, tile, "__h", "__m"), "tiles")
    kinds = dict(packed.dtypes)
    key = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, *tiles])
    schema = f"{key}, p long, level double, n long, label long"

    def run(every_cell: bool):
        def inner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i in range(batch.num_rows):
                    flat, halo = batch.column("cells")[i].values, batch.column("halo")[i].as_py() or []
                    p = np.asarray(flat.field("p"))
                    level, n, label = flood(p, np.asarray(flat.field("__h")), np.asarray(flat.field("__m")), dims, steps, [(h["p"], h["level"], h["n"], h["label"]) for h in halo])
                    take = np.ones(len(p), bool)
                    if not every_cell:
                        rim = _coordinates(p, dims) % tile
                        take = (label != 0) & ((rim == 0) | (rim == tile - 1)).any(axis=1)
                    k = int(take.sum())
                    own = [pa.array([batch.column(c)[i].as_py()] * k, batch.schema.field(c).type) for c in [*by, *tiles]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(p[take]), pa.array(level[take]), pa.array(n[take]), pa.array(label[take])], [*by, *tiles, "p", "level", "n", "label"])

        return inner

    b = _bits(dims)
    coordinates = [F.shiftright("p", b * (dims - 1 - k)).bitwiseAND((1 << b) - 1) for k in range(dims)]

    def around(borders: DataFrame, *keep: str) -> DataFrame:
        """Border cells at the other tiles that they touch."""
        near = F.array(*[F.struct(*[F.floor((c + o) / tile).cast("int").alias(f"__t{k}") for k, (c, o) in enumerate(zip(coordinates, s, strict=True))]) for s in steps])
        other = F.array_distinct(F.filter(near, lambda t: t != F.struct(*tiles)))
        return borders.withColumn("__o", F.explode(other)).select(*by, *[F.col(f"__o.{t}").alias(t) for t in tiles], *keep)

    def flooded(some: DataFrame, borders: DataFrame | None, every_cell: bool) -> DataFrame:
        if borders is None:
            some = some.withColumn("halo", F.lit(None).cast("array<struct<p:bigint,level:double,n:bigint,label:bigint>>"))
        else:
            halo = around(borders, "p", "level", "n", "label").groupBy(*by, *tiles).agg(F.collect_list(F.struct("p", "level", "n", "label")).alias("halo"))  # a tile's surroundings
            some = some.join(_met(halo), [*by, *tiles], "left")
        return some.mapInArrow(run(every_cell), schema)

    borders = written(flooded(packed, None, False), "borders")
    changed = borders
    while not changed.isEmpty():
        active = around(changed).distinct()
        new = written(flooded(packed.join(_met(active), [*by, *tiles], "left_semi"), borders, False), "borders")
        old, same = borders, [*by, *tiles, "p", "level", "n", "label"]
        changed = new.join(_met(old), same, "left_anti")
        borders = written(old.join(_met(active), [*by, *tiles], "left_anti").unionByName(new), "borders")
        changed = written(changed, "changed")
        forget(old, new)
    out = flooded(packed, borders, True)
    return out.select(*by, *[c.alias(a) for c, a in zip(coordinates, at, strict=True)], "label")


def instance_types(instances: DataFrame, types: DataFrame, by: Sequence[str], at: Sequence[str], label: str = "label", kind: str = "type") -> DataFrame:
    """(by, label, type, share): the type that most of an instance's cells have (the least of equal ones; background 0 only if there is no other), and its share of the cells."""
    each = instances.where(F.col(label) != 0).join(types.select(*by, *[F.col(c).cast("long").alias(c) for c in at], kind), [*by, *at], "left")
    counts = each.groupBy(*by, label, F.coalesce(kind, F.lit(0)).alias(kind)).agg(F.count("*").alias("__n"))
    best = F.max(F.struct((F.col(kind) != 0).alias("real"), F.col("__n").alias("n"), (-F.col(kind)).alias("k")))
    out = counts.groupBy(*by, label).agg(best.alias("b"), F.sum("__n").alias("all"))
    return out.select(*by, label, (-F.col("b.k")).alias(kind), (F.col("b.n") / (F.col("all") + 1e-6)).alias("share"))


def separate_instances(cells: DataFrame, by: Sequence[str], at: Sequence[str], probability: str, border: str, weights: Sequence[float], threshold: float = 0.5, border_threshold: float = 0.4, radius: int = 2, least: int = 10, tile: int = TILE) -> DataFrame:
    """(by, at, label): touching instances told apart. The mask is where ``probability`` passes its threshold, without small components; the
    height is one less the border map, smoothed and inverted; markers are what is certain to be inside, holes filled, opened, without small ones; water does the rest."""
    cells = written(_clean(cells, by, at, probability, border), "instances")
    found = written(components(cells.where(F.col(probability) > threshold), by, at, tile=tile), "found")
    mask = drop_small(found, by, "component", least).select(*by, *at)
    mask = written(mask.join(_met(cells), [*by, *at]).select(*by, *at, F.col(border).alias("__b")), "mask")
    sure = fill_holes(mask.where(F.col("__b") < border_threshold), cells, by, at, tile=tile)
    marks = written(components(opened(sure, by, at, radius, tile), by, at, tile=tile), "marks")
    marks = drop_small(marks, by, "component", least)
    # Cells outside the mask have no height, as places without a cell.
    heights = smooth(mask.withColumn("__d", F.coalesce(1 - F.col("__b"), F.lit(0.0))), by, at, "__d", weights, tile).withColumn("__d", -F.col("__d"))
    rows = heights.join(_met(marks.select(*by, *at, (F.col("component") + 1).alias("__m"))), [*by, *at], "left")
    return watershed(rows, by, at, "__d", "__m", tile=tile)
