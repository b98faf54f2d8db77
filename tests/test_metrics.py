"""Metrics, profiling, boxes and patches against small known results.

Fixed values: the small inputs and results below are those that every implementation of these metrics must give.
"""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import boxes as B
from stratalens.operators import metrics as M
from stratalens.operators import patches as P
from stratalens.operators import profiling as PR


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def test_ranking(spark):
    df = scores(spark, [(0.5, 0), (0.5, 1), (0.2, 0), (8.3, 1)])
    assert M.roc_auc(df).first().value == pytest.approx(0.875)
    assert M.average_precision(df).first().value == pytest.approx(0.83333, abs=1e-5)
    assert M.roc_auc(scores(spark, [(0.1, 1), (0.2, 1)])).first().value is None
    soft = [np.exp(x) / np.exp(x).sum() for x in np.array([[0.1, 0.9], [0.3, 1.4], [0.2, 0.1], [0.1, 0.5], [0.1, 0.5]])]
    truth = [[1, 0], [0, 1], [0, 0], [1, 1], [0, 1]]
    long = spark.createDataFrame([(c, float(s[c]), y[c]) for s, y in zip(soft, truth, strict=True) for c in (0, 1)], "class_id int, score double, y int")
    per = M.roc_auc(long, by=("class_id",)).join(long.groupBy("class_id").agg(F.sum("y").alias("weight")), "class_id")
    assert M.averaged(per, "weighted").first().value == pytest.approx(0.56667, abs=1e-5)
    assert M.roc_auc(long).first().value == pytest.approx(0.62)


def test_froc():
    assert M.froc_score([(0.5, 0.4), (1.0, 0.8)], (0.25, 1.0)) == pytest.approx((0.2 + 0.8) / 2)


def test_confusion_and_overlap(spark):
    df = spark.createDataFrame([(0, p, y) for p, y in [(1, 1), (0, 0), (0, 1), (1, 1)]], "s int, y_pred int, y int")
    c = M.confusion_counts(df, ["s"])
    assert tuple(c.first())[1:] == (2, 0, 1, 1)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    assert c.select(M.dice(tp, fp, fn)).first()[0] == pytest.approx(0.8)
    ones = spark.createDataFrame([(5, 4, 0)], "tp int, fp int, fn int")
    for beta, want in ((1, 0.714286), (0.5, 0.609756), (2, 0.862069)):
        assert ones.select(M.f_beta(tp.cast("double"), fp.cast("double"), fn.cast("double"), beta)).first()[0] == pytest.approx(want, abs=1e-6)
    empty = spark.createDataFrame([(0, 0, 0), (0, 3, 0)], "tp int, fp int, fn int")
    assert [r[0] for r in empty.select(M.dice(tp, fp, fn)).collect()] == [None, None]
    assert [r[0] for r in empty.select(M.dice(tp, fp, fn, ignore_empty=False)).collect()] == [1.0, 0.0]
    assert [r[0] for r in empty.select(M.iou(tp, fp, fn, ignore_empty=False)).collect()] == [1.0, 0.0]


def test_reductions(spark):
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0), (2, 0, None), (2, 1, None)], "sample_id int, class_id int, value double")
    one = lambda mode: [tuple(r) for r in M.reduce_metric(f, mode).collect()]
    assert one("mean") == [(2.75, 2)] and one("sum") == [(7.0, 3)]
    assert sorted(one("mean_batch")) == [(0, 1.0, 1), (1, 3.0, 2)] and sorted(one("sum_channel")) == [(0, 3.0, 2), (1, 4.0, 1), (2, 0.0, 0)]
    with pytest.raises(ValueError):
        M.reduce_metric(f, "other")


def test_embedding_metrics(spark):
    same = spark.createDataFrame([(i % 2, [float(i // 2), 1.0]) for i in range(8)], "side int, v array<double>")
    assert abs(M.frechet_full(same, "side", "v", 2).first().value) < 1e-9
    a, b = np.array([[1, 2]] * 3, float), np.array([[2, 2], [1, 2], [1, 2]], float)
    df = spark.createDataFrame([(0, list(map(float, x))) for x in a] + [(1, list(map(float, x))) for x in b], "side int, v array<double>")
    assert M.frechet_full(df, "side", "v", 2).first().value == pytest.approx(0.4444, abs=1e-4)
    got = M.mmd_linear(df, "side", "v").first().value
    k = lambda x, y: x @ y.T
    want = (k(a, a).sum() - np.trace(k(a, a))) / 6 + (k(b, b).sum() - np.trace(k(b, b))) / 6 - 2 * k(a, b).mean()
    assert got == pytest.approx(want)


def test_cumulative_average_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 1), (float("nan"), 5), (float("inf"), 1)], "v double, w int")
    assert tuple(M.cumulative_average(df, "v", [], None).first()) == (1.5, 2.0)


def test_report(spark):
    df = spark.createDataFrame([(0, "class0", 1.0), (0, "class1", 2.0), (1, "class0", 2.0), (1, "class1", 3.0)], "s int, c string, v double")
    _, summary = PR.metrics_report(df, "s", "c", "v")
    got = {r.c: (r["mean"], r["median"], r["max"], round(r.p90, 4)) for r in summary.collect()}
    assert got == {"class0": (1.5, 1.5, 2.0, 1.9), "class1": (2.5, 2.5, 3.0, 2.9), "mean": (2.0, 2.0, 2.5, 2.4)}


def random_boxes(n, seed):
    rng = np.random.default_rng(seed)
    lo = rng.uniform(0, 100, (n, 2))
    return np.concatenate([lo, lo + rng.uniform(1, 30, (n, 2))], axis=1)


def test_overlap_join_is_the_range_join(spark):
    a = random_boxes(80, 0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id int, xmin double, ymin double, xmax double, ymax double")
    side = lambda p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    got = {(r.p_id, r.q_id): r.iou for r in B.overlap_join(side("p_"), side("q_"), "p_", "q_", "xy", 16.0).withColumn("iou", B.box_iou("p_", "q_")).collect()}
    want = B.iou_matrix(a, a)
    assert {(i, j) for i, j in zip(*np.nonzero(want), strict=True)} == {k for k, v in got.items() if v > 0}
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_suppression(spark):
    boxes, score = random_boxes(60, 1), np.random.default_rng(2).random(60)
    kept = B.suppress(boxes, score, 0.2)
    over = B.iou_matrix(boxes, boxes)
    want = []
    for i in np.argsort(-score):
        if all(over[i, j] <= 0.2 for j in want):
            want.append(i)
    assert kept.tolist() == want
    df = spark.createDataFrame([(i % 2, i, float(score[i]), *map(float, boxes[i])) for i in range(60)], "image int, id int, score double, xmin double, ymin double, xmax double, ymax double")
    got = {r.id for r in B.nms(df, ["image"], ["xmin", "ymin", "xmax", "ymax"], "score", "id", 0.2).collect()}
    assert got == {2 * k for k in B.suppress(boxes[::2], score[::2], 0.2)} | {2 * k + 1 for k in B.suppress(boxes[1::2], score[1::2], 0.2)}


def test_perfect_detection_has_full_precision(spark):
    boxes = random_boxes(12, 3)
    df = spark.createDataFrame([(i % 3, i % 2, i, 0.5 + i / 100, *map(float, r)) for i, r in enumerate(boxes)], "image_id int, label int, box_id int, score double, xmin double, ymin double, xmax double, ymax double")
    ap = B.coco_ap(df, df.drop("score", "box_id"), ["xmin", "ymin", "xmax", "ymax"], (0.5, 0.9)).collect()
    assert len(ap) == 4 and all(r.ap == pytest.approx(1.0) and r.ar == 1.0 for r in ap)
    none = B.coco_ap(df, df.drop("score", "box_id").where("label = 7"), ["xmin", "ymin", "xmax", "ymax"]).collect()
    assert all(r.ap == -1.0 for r in none)


def greedy(pred, score, truth, least, ignore):
    """Matching as it is defined, one prediction after the other."""
    over, free, out = B.iou_matrix(pred, truth), set(range(len(truth))), []
    for i in sorted(range(len(pred)), key=lambda i: (-score[i], i)):
        able = [(not ignore[j], over[i, j], j) for j in free if over[i, j] >= least]
        if not able:
            out.append(0)
            continue
        free.remove(max(able)[2])
        out.append(1 if max(able)[0] else 2)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matching_prefers_counted_truths_then_overlap_then_the_last(seed):
    rng = np.random.default_rng(seed)
    pred, truth = random_boxes(40, seed), random_boxes(30, seed + 50)
    truth = np.concatenate([truth, truth[:8], pred[:5]])
    score, ignore = rng.integers(0, 9, 40) / 9, rng.random(len(truth)) < 0.3
    ious = (0.05, 0.3, 1.0)
    scores, hits = B.match_boxes(pred, score, truth, ious, ignore=ignore)
    assert (np.diff(scores) <= 0).all()
    for t, least in enumerate(ious):
        assert hits[t].tolist() == greedy(pred, score, truth, min(least, 1 - 1e-10), ignore)
    assert B.match_boxes(pred, score, truth[:0], ious)[1].sum() == 0 and B.match_boxes(pred[:0], score[:0], truth, ious)[1].shape == (3, 0)


def test_patches_round_trip(spark):
    df = spark.createDataFrame([(1, [float(x) for x in range(16)])], "id int, v array<double>")
    cells = P.merge(P.split(df, "v", 4, 0.5), ["id"], P.gaussian_weights(4)).orderBy("position").collect()
    assert [r.value for r in cells] == pytest.approx(list(range(16)))
    assert P.dense_starts(10, 4, 4) == [0, 4, 6] and P.step_of(5, 0.5) == 2


def test_nearest_distance(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1000, 50), rng.integers(0, 1000, 40)
    p, q = spark.createDataFrame([(0, int(x)) for x in a], "g int, x int"), spark.createDataFrame([(0, int(x)) for x in b], "g int, x int")
    got = sorted((r.x, r.distance) for r in M.nearest_distance(p, q, ["g"], "x").collect())
    assert got == sorted((int(x), int(np.abs(b - x).min())) for x in a)


def test_case_stats(spark):
    df = spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 4)], "case int, v double")
    r = PR.case_stats(df, ["case"], "v").first()
    assert (r.median, r["mean"], r.stdev) == (2.0, 2.5, pytest.approx(1.118034))
