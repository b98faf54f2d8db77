"""Components, floods and morphology of cell tables against whole images."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import tiled as T


def around(at, shape, connectivity):
    for o in itertools.product((-1, 0, 1), repeat=len(at)):
        to = tuple(a + x for a, x in zip(at, o, strict=True))
        if 0 < sum(map(abs, o)) <= connectivity and all(0 <= t < n for t, n in zip(to, shape, strict=True)):
            yield to


def component_of(image, connectivity):
    """First cell of each cell's component, cells of one value together; 0 is no cell."""
    out = {}
    for at in np.ndindex(image.shape):
        if image[at] and at not in out:
            todo = [at]
            while todo:
                x = todo.pop()
                if x not in out and image[x] == image[at]:
                    out[x] = at
                    todo += [y for y in around(x, image.shape, connectivity) if image[y] == image[at]]
    return out


def flooded(height, mask, marker, connectivity):
    """Levels until nothing changes, then labels in the order of cost."""
    cost = {m: (height[m], 0) for m in map(tuple, np.argwhere((marker > 0) & mask))}
    fixed = set(cost)
    while True:
        new = dict(cost)
        for at in map(tuple, np.argwhere(mask)):
            if at in fixed:
                continue
            for n in around(at, mask.shape, connectivity):
                if n in cost:
                    c = (height[at], 0) if height[at] > cost[n][0] else (cost[n][0], cost[n][1] + 1)
                    if at not in new or c < new[at]:
                        new[at] = c
        if new == cost:
            break
        cost = new
    label = {m: int(marker[m]) for m in fixed}
    for at in sorted(cost, key=cost.get):
        if at not in fixed:
            ways = [n for n in around(at, mask.shape, connectivity) if n in cost and ((height[at], 0) if height[at] > cost[n][0] else (cost[n][0], cost[n][1] + 1)) == cost[at]]
            label[at] = min(label[n] for n in ways)
    return {at: label.get(at, 0) for at in map(tuple, np.argwhere(mask))}


def table(spark, images, *extra):
    rows = [(k, *map(int, at), *(float(e[k][at]) for e in extra)) for k, im in images.items() for at in map(tuple, np.argwhere(im))]
    names = "yxz"[: next(iter(images.values())).ndim]
    return spark.createDataFrame(rows, "im int, " + ", ".join(f"{c} int" for c in names) + "".join(f", e{i} double" for i in range(len(extra))))


@pytest.mark.parametrize(("shape", "connectivity", "tile"), [((30, 23), 1, 5), ((30, 23), 2, 4), ((9, 8, 7), 1, 3), ((9, 8, 7), 3, 4)])
def test_components_across_tiles(spark, shape, connectivity, tile):
    rng = np.random.default_rng(len(shape) + connectivity)
    images = {0: (rng.random(shape) < 0.45) * rng.integers(1, 3, shape), 1: (rng.random(shape) < 0.6).astype(int)}
    at = list("yxz"[: len(shape)])
    b = T._bits(len(shape))
    number = lambda p: sum(int(c) << b * (len(shape) - 1 - i) for i, c in enumerate(p))
    rows = table(spark, images, images)
    for value, use in (("e0", lambda im: im), (None, lambda im: (im > 0).astype(int))):
        got = {(r.im, *(r[c] for c in at)): r.component for r in T.components(rows.repartition(3), ["im"], at, value, connectivity, tile).collect()}
        want = {(k, *map(int, p)): number(first) for k, im in images.items() for p, first in component_of(use(im), connectivity).items()}
        assert got == want


def test_one_component_over_many_tiles_and_bad_rows(spark):
    """A spiral of one cell's width through 100 tiles; repeated cells and null coordinates."""
    n, snake = 40, []
    for y in range(n):
        snake += [(y, x) for x in range(n)] if y % 2 == 0 else [(y, 0 if y % 4 == 3 else n - 1)]
    df = spark.createDataFrame([("a", *p) for p in snake] + [("a", 0, 0), ("a", None, 3)], "im string, y int, x int")
    got = T.components(df, ["im"], ["y", "x"], tile=4)
    assert got.count() == len(snake) and [r.component for r in got.select("component").distinct().collect()] == [0]
    assert T.components(df.limit(0), ["im"], ["y", "x"]).collect() == []


@pytest.mark.parametrize(("seed", "connectivity", "tile"), [(0, 1, 5), (1, 2, 7), (2, 1, 3)])
def test_watershed_is_the_flood_of_the_whole_image(spark, seed, connectivity, tile):
    rng = np.random.default_rng(seed)
    shape = (23, 19)
    masks = {k: rng.random(shape) < 0.85 for k in range(2)}
    heights = {k: rng.integers(0, 6, shape) / 2 for k in range(2)}  # many plateaus
    markers = {k: np.where(rng.random(shape) < 0.02, rng.integers(1, 99, shape), 0) for k in range(2)}
    rows = table(spark, masks, heights, markers)
    got = {(r.im, r.y, r.x): r.label for r in T.watershed(rows.repartition(3), ["im"], ["y", "x"], "e0", "e1", connectivity, tile).collect()}
    assert got == {(k, *map(int, p)): v for k in masks for p, v in flooded(heights[k], masks[k], markers[k], connectivity).items()}
    assert T.watershed(rows.withColumn("e1", F.lit(0)), ["im"], ["y", "x"], "e0", "e1", tile=tile).where("label <> 0").count() == 0


def test_a_long_valley_floods_through_all_tiles(spark):
    n = 48
    path = [(0, x) for x in range(n)] + [(1, n - 1)] + [(2, x) for x in range(n)]
    df = spark.createDataFrame([(0, y, x, float(i == 3), 7 if i == 0 else 0) for i, (y, x) in enumerate(path)], "im int, y int, x int, h double, m int")
    assert {r.label for r in T.watershed(df, ["im"], ["y", "x"], "h", "m", tile=4).collect()} == {7}


def test_morphology_points_and_types(spark):
    rng = np.random.default_rng(4)
    im = rng.random((14, 15)) < 0.75
    cells, grid = table(spark, {0: im}), table(spark, {0: np.ones_like(im)})
    of = lambda df: {(r.y, r.x) for r in df.collect()}
    ball = T.disk(1)
    inside = lambda y, x: 0 <= y < 14 and 0 <= x < 15 and im[y, x]
    eroded = {(y, x) for y in range(14) for x in range(15) if all(inside(y + a, x + b) for a, b in ball)}
    assert of(T.erode(cells, ["im"], ["y", "x"], ball)) == eroded
    assert of(T.opened(cells, ["im"], ["y", "x"], 1)) == {(y + a, x + b) for y, x in eroded for a, b in ball}
    rest = component_of((~im).astype(int), 1)
    open_ = {first for p, first in rest.items() if p[0] in (0, 13) or p[1] in (0, 14)}
    assert of(T.fill_holes(cells, grid, ["im"], ["y", "x"], tile=4)) == {p for p in np.ndindex(im.shape) if im[p] or rest[p] not in open_}
    found = T.components(cells, ["im"], ["y", "x"], tile=4)
    comp = component_of(im.astype(int), 1)
    a, b = list(comp)[0], list(comp)[-1]
    points = spark.createDataFrame([(0, *map(int, a), True), (0, *map(int, b), False), (5, 0, 0, True)], "im int, y int, x int, good boolean")
    assert of(T.with_points(found, points, ["im"], ["y", "x"], positive="good")) == {p for p in comp if comp[p] == comp[a]}
    merged = T.merge_with_points(cells, cells, points, ["im"], ["y", "x"], "good", tile=4)
    assert of(merged.where("keep")) == {p for p in comp if comp[p] == comp[a]} and of(merged.where("not keep")) == {p for p in comp if comp[p] == comp[b]}
    sizes = {first: list(comp.values()).count(first) for first in comp.values()}
    assert of(T.drop_small(found, ["im"], "component", 3)) == {p for p in comp if sizes[comp[p]] >= 3}
    kinds = spark.createDataFrame([(0, y, x, (y + x) % 3) for y in range(14) for x in range(15)], "im int, y int, x int, type int")
    for r in T.instance_types(found.withColumnRenamed("component", "label").withColumn("label", F.col("label") + 1), kinds, ["im"], ["y", "x"]).collect():
        b = T._bits(2)
        mine = [(y + x) % 3 for (y, x), first in comp.items() if (int(first[0]) << b) + int(first[1]) + 1 == r.label]
        best = max((k != 0, mine.count(k), -k) for k in set(mine))
        assert r.type == -best[2] and r.share == pytest.approx(best[1] / (len(mine) + 1e-6))


def test_smoothing_and_touching_instances(spark):
    y, x = np.mgrid[0:26, 0:40]
    left, right = (y - 12) ** 2 + (x - 12) ** 2, (y - 12) ** 2 + (x - 26) ** 2
    prob = np.where(np.minimum(left, right) <= 70, 0.9, 0.1)
    border = np.where(np.abs(left - right) < 60, 0.9, 0.05)
    whole = {0: np.ones_like(prob, bool)}
    rows = table(spark, whole, {0: prob}, {0: border})
    out = {(r.y, r.x): r.label for r in T.separate_instances(rows, ["im"], ["y", "x"], "e0", "e1", [0.25, 0.5, 0.25], tile=8).collect()}
    assert set(out) == set(map(tuple, np.argwhere(prob > 0.5)))
    a, b = out[12, 8], out[12, 30]
    assert a and b and a != b and set(out.values()) == {a, b}
    assert all(v == a for (_, x), v in out.items() if x < 17) and all(v == b for (_, x), v in out.items() if x > 21)
    value = np.random.default_rng(1).random((7, 6))
    got = {(r.y, r.x): r.e0 for r in T.smooth(table(spark, {0: np.ones((7, 6), bool)}, {0: value}), ["im"], ["y", "x"], "e0", [0.2, 0.5, 0.3]).collect()}
    w = {-1: 0.2, 0: 0.5, 1: 0.3}
    for p, v in got.items():
        want = sum(w[a] * w[b] * value[p[0] - a, p[1] - b] for a in w for b in w if 0 <= p[0] - a < 7 and 0 <= p[1] - b < 6)
        assert v == pytest.approx(want)


def test_floods_and_components_send_no_table_through_the_driver(spark):
    rows = [(0, y, x, float((y * 7 + x * 3) % 5), 1 if (y, x) == (0, 0) else 2 if (y, x) == (9, 9) else 0) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "image int, y long, x long, h double, m int")
    for out in (T.watershed(df, ["image"], ["y", "x"], "h", "m", tile=4), T.components(df, ["image"], ["y", "x"], tile=4)):
        assert out.count() == 100
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_opening_and_smoothing_move_each_cell_once(spark):
    """One shuffle, to tiles that take what surrounds them along; repeated cells and nulls as before."""
    rng = np.random.default_rng(9)
    im, value = rng.random((13, 11)) < 0.8, rng.random((13, 11))
    cells = table(spark, {0: im}, {0: value})
    cells = cells.unionByName(cells.limit(5)).unionByName(spark.createDataFrame([(0, None, 1, 1.0), (1, 2, 2, None)], cells.schema))
    ball = T.disk(1)
    inside = lambda y, x: 0 <= y < 13 and 0 <= x < 11 and im[y, x]
    eroded = [(y, x) for y in range(13) for x in range(11) if all(inside(y + a, x + b) for a, b in ball)]
    opened = T.opened(cells, ["im"], ["y", "x"], 1, tile=4)
    assert sorted((r.y, r.x) for r in opened.collect()) == sorted({(y + a, x + b) for y, x in eroded for a, b in ball})
    smooth = T.smooth(cells, ["im"], ["y", "x"], "e0", [0.2, 0.5, 0.3], tile=3)
    got = {(r.im, r.y, r.x): r.e0 for r in smooth.collect()}
    w = {-1: 0.2, 0: 0.5, 1: 0.3}
    want = {(0, *map(int, p)): sum(w[a] * w[b] * value[p[0] - a, p[1] - b] for a in w for b in w if inside(p[0] - a, p[1] - b)) for p in np.argwhere(im)}
    assert got.pop((1, 2, 2)) is None and got == pytest.approx(want)
    for out in (opened, smooth):
        assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
        out = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert out.count("Exchange hashpartitioning") == 1
    assert sum(r.n for r in T.components(cells, ["im"], ["y", "x"], tile=4).groupBy("im", "y", "x").agg(F.count("*").alias("n")).collect()) == im.sum() + 1
