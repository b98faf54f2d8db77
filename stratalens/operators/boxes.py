"""Box algebra, range joins of boxes, suppression, matching and average precision.

A box is the columns xmin, ymin, [zmin,] xmax, ymax[, zmax]; two prefixes name the sides of a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.ordered import running_sums
from stratalens.storage import written

EPS = 1.1920929e-07
#: Groups of more boxes than this are worked one by one.
SMALL = 32


def _extent(axis: str, p: str = "") -> Column:
    return F.greatest(F.col(f"{p}{axis}max") - F.col(f"{p}{axis}min"), F.lit(0.0))


def area(p: str = "", axes: str = "xy") -> Column:
    return reduce(Column.__mul__, [_extent(a, p) for a in axes])


def intersection(p: str, q: str, axes: str = "xy") -> Column:
    return reduce(Column.__mul__, [F.greatest(F.least(F.col(f"{p}{a}max"), F.col(f"{q}{a}max")) - F.greatest(F.col(f"{p}{a}min"), F.col(f"{q}{a}min")), F.lit(0.0)) for a in axes])


def box_iou(p: str, q: str, axes: str = "xy") -> Column:
    i = intersection(p, q, axes)
    return i / (area(p, axes) + area(q, axes) - i + EPS)


def box_giou(p: str, q: str, axes: str = "xy") -> Column:
    i = intersection(p, q, axes)
    union = area(p, axes) + area(q, axes) - i
    hull = reduce(Column.__mul__, [F.greatest(F.col(f"{p}{a}max"), F.col(f"{q}{a}max")) - F.least(F.col(f"{p}{a}min"), F.col(f"{q}{a}min")) for a in axes])
    return i / (union + EPS) - (hull - union) / (hull + EPS)


def center_distance(p: str, q: str, axes: str = "xy") -> Column:
    mid = lambda s, a: (F.col(f"{s}{a}min") + F.col(f"{s}{a}max")) / 2
    return F.sqrt(reduce(Column.__add__, [(mid(p, a) - mid(q, a)) * (mid(p, a) - mid(q, a)) for a in axes]))


def convert(source: str, axes: str = "xy") -> dict[str, Column]:
    """Corner columns from another layout: ``corner_size`` (min and size) or ``center_size``."""
    out = {}
    for a in axes:
        size = F.col(f"{a}size")
        low = F.col(f"{a}min") if source == "corner_size" else F.col(f"{a}center") - size / 2
        out[f"{a}min"], out[f"{a}max"] = low, low + size
    return out


def clip(axes: str, limits: dict[str, float]) -> dict[str, Column]:
    return {f"{a}{s}": F.least(F.greatest(F.col(f"{a}{s}"), F.lit(0.0)), F.lit(float(limits[a]))) for a in axes for s in ("min", "max")}


def _tiles(df: DataFrame, p: str, axes: str, tile: float) -> DataFrame:
    for a in axes:
        lo, hi = F.floor(F.col(f"{p}{a}min") / tile), F.floor(F.col(f"{p}{a}max") / tile)
        df = df.withColumn(f"__{a}", F.explode(F.sequence(lo, F.greatest(hi, lo))))
    return df


def overlap_join(left: DataFrame, right: DataFrame, p: str, q: str, axes: str, tile: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of boxes that overlap, met in tiles of a grid; a pair that shares several tiles is reported in the one of its intersection's lower corner.

    So the join is an equi join on tiles, and no table of all pairs is made.
    """
    a, b = _tiles(left, p, axes, tile), _tiles(right, q, axes, tile)
    keys = [*(on or []), *[f"__{x}" for x in axes]]
    pairs = a.join(b, keys)
    meets = reduce(Column.__and__, [(F.col(f"{p}{x}min") <= F.col(f"{q}{x}max")) & (F.col(f"{q}{x}min") <= F.col(f"{p}{x}max")) for x in axes])
    first = reduce(Column.__and__, [F.floor(F.greatest(F.col(f"{p}{x}min"), F.col(f"{q}{x}min")) / tile) == F.col(f"__{x}") for x in axes])
    return pairs.where(meets & first).drop(*[f"__{x}" for x in axes])


def centers_in_boxes(points: DataFrame, boxes: DataFrame, axes: str, tile: float, on: list[str] | None = None) -> DataFrame:
    """Points (columns x, y, [z]) with the boxes that hold them strictly inside."""
    for a in axes:
        points = points.withColumn(f"__{a}", F.floor(F.col(a) / tile))
    pairs = points.join(_tiles(boxes, "", axes, tile), [*(on or []), *[f"__{a}" for a in axes]])
    return pairs.where(reduce(Column.__and__, [(F.col(a) > F.col(f"{a}min") + 0.01) & (F.col(a) < F.col(f"{a}max") - 0.01) for a in axes])).drop(*[f"__{a}" for a in axes])


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of boxes given as rows of lower then upper corners; of many groups at a time if there are axes before the rows."""
    d = a.shape[-1] // 2
    lo, hi = np.maximum(a[..., :, None, :d], b[..., None, :, :d]), np.minimum(a[..., :, None, d:], b[..., None, :, d:])
    i = np.clip(hi - lo, 0, None).prod(axis=-1)
    size = lambda x: np.clip(x[..., d:] - x[..., :d], 0, None).prod(axis=-1)
    return i / (size(a)[..., :, None] + size(b)[..., None, :] - i + EPS)


def suppress(boxes: np.ndarray, scores: np.ndarray, threshold: float, most: int | None = None) -> np.ndarray:
    """Positions kept by greedy non-maximum suppression, best first; overlaps up to the threshold stay."""
    left, kept = np.argsort(-scores, kind="stable"), []
    while len(left) and (most is None or len(kept) < most):
        kept.append(left[0])
        overlap = iou_matrix(boxes[left[:1]], boxes[left[1:]])[0]
        left = left[1:][overlap <= threshold]
    return np.array(kept, int)


def suppress_groups(boxes: np.ndarray, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float, most: int | None = None) -> np.ndarray:
    """Positions that ``suppress`` keeps in each of many groups whose rows stand best first; small groups of one size go at a time."""
    keep = np.zeros(len(boxes), bool)
    alone = (sizes > SMALL) | (np.add.reduceat(np.isnan(scores), starts) > 0)
    for a, n in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True):
        keep[a + suppress(boxes[a : a + n], scores[a : a + n], threshold, most)] = True
    for n in np.unique(sizes[~alone]).tolist():
        at = starts[~alone & (sizes == n)][:, None] + np.arange(n)
        alive = np.ones(at.shape, bool)
        if n > 1:
            apart = iou_matrix(boxes[at], boxes[at]) <= threshold
            for i in range(n - 1):
                alive[:, i + 1 :] &= apart[:, i, i + 1 :] | ~alive[:, i, None]
        if most is not None:
            alive &= np.cumsum(alive, axis=1) <= most
        keep[at[alive]] = True
    return np.flatnonzero(keep)


def sorted_groups(it: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group ends) of whole groups, many at a time, from batches in which the rows of a group stand together.

    Groups are small and many (an image's boxes), so a call of Python for each would cost more than the work.
    """
    held: list[pa.RecordBatch] = []  # parts of the group that may go on
    last: tuple | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(c)[0].as_py() for c in by)
        end = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in by)
        if held and first == last and end == last:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        ends = _group_ends(table, by)
        held, last = [batch], end
        if len(ends) > 1:
            yield table.slice(0, int(ends[-2])), ends[:-1]
            held = table.slice(int(ends[-2])).to_batches()
        elif table.num_rows > batch.num_rows:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _group_ends(table, by)


def _group_ends(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    last = np.zeros(table.num_rows, bool)
    last[-1] = True
    for c in by:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        last[:-1] |= code[1:] != code[:-1]
    return np.flatnonzero(last) + 1


def nms(df: DataFrame, by: list[str], corners: list[str], score: str, key: str, threshold: float, most: int | None = None) -> DataFrame:
    """Boxes kept in each group (image, or image and class), best first."""
    rows = df.repartition(*by).sortWithinPartitions(*by, F.desc(score), key)

    def run(it):
        for table, ends in sorted_groups(it, by):
            boxes = np.stack([table.column(c).to_numpy() for c in corners], axis=1).astype(float)
            scores = table.column(score).to_numpy().astype(float)
            starts = np.concatenate([[0], ends[:-1]])
            yield from table.take(pa.array(suppress_groups(boxes, scores, starts, ends - starts, threshold, most))).to_batches()

    return rows.mapInArrow(run, df.schema)


def match_boxes(pred: np.ndarray, score: np.ndarray, truth: np.ndarray, ious: tuple[float, ...], most: int = 100, ignore: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores best first, IoU thresholds x predictions: 1 for a hit, 2 for a prediction on an ignored truth, 0 for a miss).

    In the order of scores each prediction takes one truth that is still free and overlaps it by the threshold
    or more: a counted one before an ignored one, then the one of greatest overlap, then the last. A threshold
    of 1 leaves room for rounding.
    """
    order = np.argsort(-score, kind="stable")[:most]
    hits = np.zeros((len(ious), len(order)), np.int8)
    if not len(order) or not len(truth):
        return score[order], hits
    ignored = np.zeros(len(truth), bool) if ignore is None else np.asarray(ignore, bool)
    overlap = iou_matrix(pred[order], truth)
    # Truths by rank of choice: for each prediction the columns from the best to the worst.
    ranked = np.lexsort((np.broadcast_to(-np.arange(len(truth)), overlap.shape), -overlap, np.broadcast_to(ignored, overlap.shape)), axis=1)
    enough = np.take_along_axis(overlap, ranked, axis=1)
    free = np.ones((len(ious), len(truth)), bool)
    least = np.minimum(np.asarray(ious, float), 1 - 1e-10)[:, None]
    for i in range(len(order)):
        open_ = free[:, ranked[i]] & (enough[i] >= least)
        took = np.flatnonzero(open_.any(axis=1))
        who = ranked[i][open_[took].argmax(axis=1)]
        free[took, who] = False
        hits[took, i] = 1 + ignored[who]
    return score[order], hits


def match_groups(pred: np.ndarray, truth: np.ndarray, there: np.ndarray, ignored: np.ndarray, ious: Sequence[float]) -> np.ndarray:
    """``match_boxes`` for many groups at a time, as (groups, ways to ignore, thresholds, predictions).

    Predictions (groups, p, corners) stand best first; truths (groups, t, corners) are those of ``there``, ignored by ``ignored`` (groups, ways, t).
    """
    overlap = iou_matrix(pred, truth)
    least = np.minimum(np.asarray(ious, float), 1 - 1e-10)[:, None]
    groups, ways, last = len(pred), ignored.shape[1], truth.shape[1] - 1
    free = np.repeat(np.repeat(there[:, None, None], ways, axis=1), len(least), axis=2)
    counted = ~ignored[:, :, None]
    hits = np.zeros((groups, ways, len(least), pred.shape[1]), np.int8)
    for i in range(pred.shape[1]):
        o = overlap[:, None, None, i]
        open_ = free & (o >= least)
        best = open_ & counted
        has = best.any(axis=-1, keepdims=True)
        took = open_.any(axis=-1)
        who = last - np.where(np.where(has, best, open_), o, -1.0)[..., ::-1].argmax(axis=-1)
        g, a, k = np.nonzero(took)
        free[g, a, k, who[took]] = False
        hits[..., i] = np.where(took, 2 - has[..., 0], 0)
    return hits


def coco_ap(pred: DataFrame, truth: DataFrame, corners: list[str], ious: tuple[float, ...] = (0.5,), recalls: int = 101, most: int = 100, recall_at: tuple[int, ...] = (), areas: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """label, iou, ap, ar, n_truth, and an ar_k for each k of ``recall_at`` (recall of the k best detections of an image): matching within (image, class), then precision envelopes over all images of a class; -1 without truths.

    A truth whose boolean column ``ignore`` is true doesn't count, nor does a prediction that takes it. With
    ``areas`` (name: least and greatest box area) there is a row for each of them, named in ``area``: truths of
    other areas are ignored there, and so are predictions of other areas that take no truth.

    Matches of equal score combine, and running sums in the order of scores are spread over ranges.
    """
    named = areas or {"all": (-math.inf, math.inf)}
    limits = list(named.values())
    if "ignore" not in truth.columns:
        truth = truth.withColumn("ignore", F.lit(False))
    side = lambda df, k: df.select("image_id", "label", F.lit(k).alias("side"), *[F.col(c).cast("double").alias(c) for c in corners], (F.col("score").cast("double") if k else F.lit(0.0)).alias("score"), (F.col("box_id").cast("long") if k else F.lit(0).cast("long")).alias("box_id"), (F.lit(False) if k else F.coalesce("ignore", F.lit(False))).alias("ignore"))
    rows = side(truth, 0).unionByName(side(pred, 1)).repartition("image_id", "label").sortWithinPartitions("image_id", "label", "side", F.desc("score"), "box_id")
    half = len(corners) // 2

    def match(it):
        for table, ends in sorted_groups(it, ["image_id", "label"]):
            boxes = np.stack([table.column(c).to_numpy() for c in corners], axis=1)
            scores, sides, labels, ignored = (table.column(c).to_numpy() for c in ("score", "side", "label", "ignore"))
            size = np.prod(boxes[:, half:] - boxes[:, :half], axis=1)
            starts = np.concatenate([[0], ends[:-1]])
            sizes = ends - starts
            truths = np.add.reduceat((sides == 0).astype(np.int64), starts)
            found = np.minimum(sizes - truths, most)
            other = np.stack([(size < lo) | (size > hi) for lo, hi in limits])
            place = np.arange(len(size))
            hits = np.zeros((len(place), len(limits), len(ious)), np.int8)
            alone = (sizes > 2 * SMALL) | (np.add.reduceat(np.isnan(scores), starts) > 0)
            for a, t, p in zip(starts[alone].tolist(), truths[alone].tolist(), found[alone].tolist(), strict=True):
                cut = a + t
                for w in range(len(limits) if p else 0):
                    hits[cut : cut + p, w] = match_boxes(boxes[cut : cut + p], scores[cut : cut + p], boxes[a:cut], ious, most, ignored[a:cut] | other[w, a:cut])[1].T
            for p in np.unique(found[~alone & (found > 0)]).tolist():
                here = ~alone & (found == p)
                n = truths[here]
                at = starts[here][:, None] + np.arange(max(1, int(n.max())))
                there = np.arange(at.shape[1]) < n[:, None]
                at = np.where(there, at, 0)
                mine = (starts[here] + n)[:, None] + np.arange(p)
                hits[mine] = match_groups(boxes[mine], boxes[at], there, (ignored | other)[:, at].transpose(1, 0, 2), ious).transpose(0, 3, 1, 2)
            rank = place - np.repeat(starts + truths, sizes) + 1
            top = (rank > 0) & (rank <= most)
            if top.any():
                hits = np.where((hits == 0) & other.T[:, :, None], 2, hits)[top].reshape(int(top.sum()), -1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(hits) + 1, dtype=np.int32) * hits.shape[1]), pa.array(hits.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(labels[top], pa.int32()), pa.array(scores[top]), pa.array(rank[top], pa.int32()), flat], ["label", "score", "rank", "hits"])

    hits = written(rows.mapInArrow(match, "label int, score double, rank int, hits array<int>"), "matches").select("label", "score", "rank", F.posexplode("hits").alias("k", "hit"))
    right, counts = (F.col("hit") == 1).cast("long"), (F.col("hit") < 2).cast("long")
    each = hits.groupBy("label", "k", "score").agg(F.sum(right).alias("tp"), F.sum(counts).alias("c"))
    first = hits.groupBy("label", "k").agg(*[F.sum(F.when(F.col("rank") <= m, right).otherwise(0)).alias(f"first_{m}") for m in recall_at], F.count("*").alias("found"))
    ends = reduce(lambda a, b: a * b, [F.col(hi).cast("double") - F.col(lo).cast("double") for lo, hi in zip(corners[:half], corners[half:], strict=True)])
    inside = F.array(*[((ends >= lo) & (ends <= hi) & ~F.coalesce("ignore", F.lit(False))).cast("long") for lo, hi in limits])
    n = truth.select(F.col("label").cast("int").alias("label"), F.posexplode(inside).alias("a", "in")).groupBy("label", "a").agg(F.sum("in").alias("n_truth"))
    area = F.floor(F.col("k") / len(ious)).cast("int")
    curve = running_sums(each, ["label", "k"], [F.desc("score")], {"tps": F.col("tp"), "cs": F.col("c")}).withColumn("a", area).join(n, ["label", "a"], "left").where("cs > 0 or n_truth is null or n_truth = 0")
    curve = curve.withColumn("recall", F.when(F.col("n_truth") > 0, F.col("tps") / F.col("n_truth")))
    step = F.floor(F.col("recall") * (recalls - 1) + 1e-9).cast("int")  # the highest recall point that is reached
    best = curve.groupBy("label", "k", step.alias("step")).agg(F.max(F.when(F.col("cs") > 0, F.col("tps") / F.col("cs"))).alias("p"), F.max("recall").alias("ar"))
    up = Window.partitionBy("label", "k").orderBy(F.desc("step"))
    best = best.withColumn("envelope", F.max("p").over(up)).withColumn("below", F.coalesce(F.lead("step").over(up), F.lit(-1)))
    ap = F.sum(F.col("envelope") * (F.col("step") - F.col("below"))) / recalls
    out = first.join(best.groupBy("label", "k").agg(ap.alias("ap"), F.max("ar").alias("ar")), ["label", "k"], "left").withColumn("a", area).join(n, ["label", "a"], "left")
    iou = F.element_at(F.array(*[F.lit(float(x)) for x in ious]), F.col("k") % len(ious) + 1)
    names = [F.element_at(F.array(*map(F.lit, named)), F.col("a") + 1).alias("area")] if areas else []
    none = F.coalesce("n_truth", F.lit(0)) == 0
    of = lambda c: F.when(none, -1.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return out.select("label", iou.alias("iou"), *names, of(F.col("ap")).alias("ap"), of(F.col("ar")).alias("ar"), F.coalesce("n_truth", F.lit(0)).alias("n_truth"), *[of(F.col(f"first_{m}") / F.col("n_truth")).alias(f"ar_{m}") for m in recall_at])
