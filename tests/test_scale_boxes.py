"""Box kernels that take many groups at a time against those of one group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import boxes as B
from stratalens.operators import detection as DT

CORNERS = "xmin double, ymin double, xmax double, ymax double"


def some_boxes(n, rng):
    low = rng.random((n, 2)) * 30
    return np.concatenate([low, low + rng.random((n, 2)) * 20], axis=1)


@pytest.mark.parametrize("most", [None, 2])
def test_groups_are_suppressed_together_as_one_by_one(most):
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1, 9, 60), [B.SMALL + 9]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    boxes = some_boxes(int(sizes.sum()), rng)
    scores = np.concatenate([-np.sort(-rng.random(n)) for n in sizes])
    scores[starts[3]] = np.nan
    want = sorted(a + k for a, n in zip(starts, sizes, strict=True) for k in B.suppress(boxes[a : a + n], scores[a : a + n], 0.2, most))
    assert B.suppress_groups(boxes, scores, starts, sizes, 0.2, most).tolist() == want


def test_groups_are_matched_together_as_one_by_one():
    rng = np.random.default_rng(6)
    ious = (0.05, 0.3, 1.0)
    pred = np.stack([some_boxes(7, rng) for _ in range(40)])
    truth = np.stack([some_boxes(9, rng) for _ in range(40)])
    truth[:, :3], truth[:, 5] = pred[:, 1:4], truth[:, 4]
    there = np.arange(9) < rng.integers(0, 10, 40)[:, None]
    ignored = rng.random((40, 2, 9)) < 0.3
    got = B.match_groups(pred, truth, there, ignored, ious)
    for g in range(40):
        for w in range(2):
            n = int(there[g].sum())
            assert got[g, w].tolist() == B.match_boxes(pred[g], -np.arange(7.0), truth[g, :n], ious, ignore=ignored[g, w, :n])[1].tolist()


def test_boxes_meet_their_anchors_without_a_row_for_each_place(spark):
    rng = np.random.default_rng(7)
    box = some_boxes(50, rng).round(1)
    rows = [(i % 9, (i // 9) % 4 if i < 40 else i, *map(float, b)) for i, b in enumerate(box)] + [(1, None, *map(float, box[0])), (1, 77, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, f"image_id int, box_id long, {CORNERS}")
    halves = [[(8.0, 8.0), (11.0, 6.0)], [(16.0, 16.0)]]
    got = DT.match_anchors(df, ["image_id"], "box_id", [[8, 12], [1, 6]], [[16, 16], [32, 32]], halves)
    assert "Generate" not in got._jdf.queryExecution().toString()
    want = {}
    for image, key in {r[:2] for r in rows}:
        mine = [np.array(r[2:]) for r in rows if r[:2] == (image, key) and None not in r[2:]]
        found = []
        for level, (n, m, st) in enumerate(((8, 12, 16.0), (1, 6, 32.0))):
            each = sorted((((i * st - (b[0] + b[2]) / 2) ** 2 + (j * st - (b[1] + b[3]) / 2) ** 2, i * m + j, k) for k, b in enumerate(mine) for i in range(n) for j in range(m)))[:4]
            for _, place, k in each:
                x, y = place // m * st, place % m * st
                for s, (hx, hy) in enumerate(halves[level]):
                    iou = B.iou_matrix(mine[k][None], np.array([[x - hx, y - hy, x + hx, y + hy]]))[0, 0]
                    inside = mine[k][0] + 0.01 < x < mine[k][2] - 0.01 and mine[k][1] + 0.01 < y < mine[k][3] - 0.01
                    found.append((iou, level, place, s, inside))
        ious = np.array([f[0] for f in found])
        least = ious.mean() + ious.std(ddof=1) if len(found) else 0
        for iou, level, place, s, inside in found:
            at = (image, level, place, s)
            if iou >= least and inside and (at not in want or want[at][1] < iou):
                want[at] = (key, iou)
    assert {(r.image_id, r.level, r.place, r["shape"]): (r.box_id, pytest.approx(r.iou)) for r in got.collect()} == want


@pytest.mark.parametrize("axes", ["xy", "xyz"])
def test_masks_of_boxes_count_cells_without_a_row_for_each(spark, axes):
    rng = np.random.default_rng(8)
    low = rng.integers(-20, 20, (60, len(axes))) + rng.random((60, len(axes)))
    both = np.concatenate([low, low + rng.random(low.shape) * 30 - 1], axis=1)
    df = spark.createDataFrame([(i % 7 if i % 7 else None, *map(float, b)) for i, b in enumerate(both)], "g int, " + ", ".join(f"{a}{s} double" for s in ("min", "max") for a in axes))
    ends = [f(a).alias(f"{a}{s}") for a in axes for s, f in (("min", F.min), ("max", lambda a: F.max(a) + 1))]
    want = DT.box_cells(df, axes).select("g", *axes).distinct().groupBy("g").agg(F.count("*").alias("cells"), *ends)
    got = DT.masks_of_boxes(df, ["g"], axes)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().toString().count("Exchange") == 1  # boxes move once
