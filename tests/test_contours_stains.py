"""Outlines against counts of cells, stains against known mixtures."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stratalens.operators import contours as C
from stratalens.operators import stains as S


def test_rings_go_round_instances_and_holes(spark):
    rng = np.random.default_rng(2)
    im = np.where(rng.random((12, 14)) < 0.62, rng.integers(1, 3, (12, 14)), 0)
    im[3:8, 4:9] = 5
    im[5, 6] = 0
    im[6, 7] = 1  # touches the hole at a corner
    rows = [(0, int(y), int(x), int(im[y, x])) for y, x in np.ndindex(im.shape)]
    cells = spark.createDataFrame(rows, "im int, y int, x int, label int").repartition(3)
    chained = C.rings(cells, ["im"]).persist()
    rings = defaultdict(list)
    for r in chained.orderBy("ring", "place").collect():
        rings[r.label, r.ring].append((r.place, r.y, r.x, r.side))
    assert all([p for p, *_ in v] == list(range(len(v))) for v in rings.values())
    starts = lambda y, x, s: (y + C.SIDES[s][2][0], x + C.SIDES[s][2][1])
    for v in rings.values():
        walk = [starts(*e[1:]) for e in v]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(walk, walk[1:] + walk[:1], strict=True))
    corners = defaultdict(list)
    for r in C.polygons(chained, ["im"]).orderBy("place").collect():
        corners[r.label, r.ring].append((r.y, r.x))
    area = {k: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(v, v[1:] + v[:1], strict=True)) / 2 for k, v in corners.items()}
    for label in np.unique(im[im > 0]):
        assert sum(a for (k, _), a in area.items() if k == label) == (im == label).sum()
    assert sorted(a for (k, _), a in area.items() if k == 5) == [-2.0, 25.0]  # holes that meet at a corner share a ring
    for r in C.measures(chained, ["im"]).collect():
        v = corners[r.label, r.ring]
        assert (r.area, r.corners, r.length) == (area[r.label, r.ring], len(v), len(rings[r.label, r.ring]))
        assert (r.least_y, r.most_y, r.least_x, r.most_x) == (min(y for y, _ in v), max(y for y, _ in v), min(x for _, x in v), max(x for _, x in v))
    assert C.rings(cells.where("label = 0"), ["im"]).collect() == []


def mixture(rng, stains, amounts):
    od = amounts @ np.array(stains).T
    return np.clip(240 * np.exp(-od) - 1, 0, 255)


def test_stains_of_a_known_mixture_come_back(spark):
    rng = np.random.default_rng(0)
    he = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
    he /= np.linalg.norm(he, axis=0)
    part = rng.random((3000, 2)) * [1.2, 1.0] + 0.25
    part[:600, 0], part[600:1200, 1] = 0.01, 0.01  # pixels of one stain alone
    rows = [(k, i, *map(float, p)) for k, scale in ((0, 1.0), (1, 0.7)) for i, p in enumerate(mixture(rng, he, part * scale))]
    df = spark.createDataFrame([*rows, (0, -1, None, 1.0, 1.0), (0, -2, 300.0, 1.0, 1.0), (9, 0, 239.0, 239.0, 239.0)], "im int, i int, r double, g double, b double")
    found = {r.im: np.array(r[1:]).reshape(2, 3) for r in S.extract_stains(df, ["im"], faint=0.02).collect()}
    assert set(found) == {0, 1}  # the last image is all light
    for v in found.values():
        got = v / np.linalg.norm(v, axis=1)[:, None]
        assert abs(got @ he).max(axis=1).min() > 0.999 and got[0] @ he[:, 0] > 0.999
    # The same slide, stained less, gives the same normalised colours.
    out = S.normalize_stains(df, ["im"], faint=0.02, whole=False)
    a, b = ({r.i: (r.r, r.g, r.b) for r in out.where(F.col("im") == k).collect()} for k in (0, 1))
    assert set(a) == set(b) == set(range(3000))
    assert np.abs(np.array([a[i] for i in range(3000)]) - np.array([b[i] for i in range(3000)])).max() < 2.0
    whole = S.normalize_stains(df, ["im"], faint=0.02).where("im = 0").first()
    assert isinstance(whole.r, int) and 0 <= whole.r <= 255


def test_rings_that_cross_tiles_are_those_of_one_tile(spark):
    rng = np.random.default_rng(5)
    im = np.where(rng.random((17, 19)) < 0.7, rng.integers(1, 3, (17, 19)), 0)
    im[2:14, 3:15] = 5
    im[6:9, 6:10] = 0
    cells = spark.createDataFrame([(0, int(y), int(x), int(im[y, x])) for y, x in np.ndindex(im.shape)], "im int, y int, x int, label int")
    whole, parts = (sorted(map(tuple, C.rings(cells, ["im"], tile=t).collect())) for t in (32, 5))
    assert whole == parts and len(whole) > 400


def test_edges_move_only_where_rings_cross_tiles(spark):
    cells = spark.range(64 * 64).selectExpr("0 as im", "id div 64 as y", "id % 64 as x", "1L as label")
    plan = C.rings(cells, ["im"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert C.measures(C.rings(cells, ["im"]), ["im"]).first().area == 4096.0
