"""Metrics in two levels: per sample and class, then reduced over samples, classes or both.

Values that can't be computed are NULL (never NaN) and are left out of means and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.ordered import running_sums

EPS = 1.1920929e-07
MODES = ("none", "mean", "sum", "mean_batch", "sum_batch", "mean_channel", "sum_channel")


def reduce_metric(df: DataFrame, mode: str, value: str = "value", sample: str = "sample_id", cls: str = "class_id") -> DataFrame:
    """Reduction of (sample, class, value); every result comes with the count of what it is made of.

    ``mean`` is the mean over samples of each sample's mean over classes, not a mean of all values.
    """
    v = F.col(value)
    if mode == "none":
        return df.select(sample, cls, v.alias("value"), v.isNotNull().cast("long").alias("n"))
    if mode in ("mean_batch", "sum_batch"):
        f = F.avg if mode == "mean_batch" else F.sum
        return df.groupBy(cls).agg(F.coalesce(f(v), F.lit(0.0)).alias("value"), F.count(v).alias("n"))
    if mode in ("mean_channel", "sum_channel"):
        f = F.avg if mode == "mean_channel" else F.sum
        return df.groupBy(sample).agg(F.coalesce(f(v), F.lit(0.0)).alias("value"), F.count(v).alias("n"))
    if mode == "sum":
        return df.agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("value"), F.count(v).alias("n"))
    if mode == "mean":
        per = df.groupBy(sample).agg(F.avg(v).alias("m"))
        return per.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("value"), F.count("m").alias("n"))
    raise ValueError(f"unknown reduction {mode}; one of {MODES}")


def confusion_counts(df: DataFrame, by: list[str], pred: str = "y_pred", truth: str = "y") -> DataFrame:
    """tp, fp, tn, fn of binary predictions for each group, in one aggregation."""
    p, y = F.col(pred), F.col(truth)
    count = lambda cond: F.sum(cond.cast("long"))
    return df.groupBy(*by).agg(count((p == 1) & (y == 1)).alias("tp"), count((p == 1) & (y == 0)).alias("fp"), count((p == 0) & (y == 0)).alias("tn"), count((p == 0) & (y == 1)).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.when(b != 0, a / b)


def confusion_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """The confusion-matrix family by its short names."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    tpr, tnr, ppv, npv = ratio(tp, tp + fn), ratio(tn, fp + tn), ratio(tp, tp + fp), ratio(tn, tn + fn)
    return {
        "tpr": tpr,
        "tnr": tnr,
        "ppv": ppv,
        "npv": npv,
        "fnr": ratio(fn, tp + fn),
        "fpr": ratio(fp, fp + tn),
        "fdr": ratio(fp, fp + tp),
        "for": ratio(fn, fn + tn),
        "pt": ratio(F.sqrt(tpr * (1 - tnr)) + tnr - 1, tpr + tnr - 1),
        "ts": ratio(tp, tp + fn + fp),
        "acc": ratio(tp + tn, tp + fp + tn + fn),
        "ba": (tpr + tnr) / 2,
        "f1": ratio(2 * tp, 2 * tp + fn + fp),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fm": F.sqrt(ppv * tpr),
        "bm": tpr + tnr - 1,
        "mk": ppv + npv - 1,
    }


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    den = (1 + b) * tp + b * fn + fp
    return F.when(den == 0, F.lit(0.0)).otherwise((1 + b) * tp / F.nullif(den, F.lit(0.0)))


def dice(tp: Column, fp: Column, fn: Column, ignore_empty: bool = True) -> Column:
    """NULL for empty truth if those are ignored; else 1 if both are empty and 0 if only the truth is."""
    empty = tp + fn == 0
    if ignore_empty:
        return F.when(~empty, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))
    return F.when(empty, (tp + fp == 0).cast("double")).otherwise(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))


def iou(tp: Column, fp: Column, fn: Column, ignore_empty: bool = True) -> Column:
    whole = F.when(tp + fp + fn > 0, tp / F.nullif(tp + fp + fn, F.lit(0))).otherwise(F.lit(1.0))
    return F.when(tp + fn > 0, whole) if ignore_empty else whole


def generalized_dice(df: DataFrame, sample: str, weight: str = "square") -> DataFrame:
    """Per sample from (sample, class, tp, fp, fn): classes weighted by 1 / truth size (squared, simple or uniform); an empty class gets the sample's largest finite weight."""
    y = (F.col("tp") + F.col("fn")).cast("double")
    w = {"square": F.when(y > 0, 1 / (F.nullif(y, F.lit(0.0)) * y)), "simple": F.when(y > 0, 1 / F.nullif(y, F.lit(0.0))), "uniform": F.lit(1.0)}[weight]
    full = F.coalesce(w, F.max(w).over(Window.partitionBy(sample)), F.lit(0.0))
    x = df.withColumn("__w", full)
    num = F.sum(2 * F.col("__w") * F.col("tp"))
    den = F.sum(F.col("__w") * (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    preds = F.sum(F.col("tp") + F.col("fp"))
    return x.groupBy(sample).agg(F.when(den > 0, num / F.nullif(den, F.lit(0.0))).when(preds == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"))


def regression(df: DataFrame, sample: str, pred: str, truth: str, max_value: float) -> DataFrame:
    """mse, mae, rmse, psnr of each sample; roots and logarithms are taken before any reduction."""
    d = F.col(pred) - F.col(truth)
    per = df.groupBy(sample).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
    return per.withColumn("rmse", F.sqrt("mse")).withColumn("psnr", F.when(F.col("mse") > 0, 20 * F.log10(F.lit(float(max_value))) - 10 * F.log10("mse")))


def _score_groups(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    return df.groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("c"))


def roc_auc(df: DataFrame, score: str = "score", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve for each group, ties sharing credit; NULL if all truths are equal.

    Rows of a score combine before the shuffle; the running sums are over distinct scores.
    """
    by = list(by)
    g = _score_groups(df, by, score, y).withColumn("n", F.col("c") - F.col("p"))
    g = running_sums(g, by, [F.col(score)], {"upto": F.col("n")}).withColumn("below", F.col("upto") - F.col("n"))
    return g.groupBy(*by).agg(ratio(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("value"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise average precision, ties in one step."""
    by = list(by)
    g = running_sums(_score_groups(df, by, score, y), by, [F.desc(score)], {"cp": F.col("p"), "cc": F.col("c")})
    return g.groupBy(*by).agg(ratio(F.sum(F.col("p") * F.col("cp") / F.col("cc")), F.sum("p").cast("double")).alias("value"))


def averaged(per_class: DataFrame, how: str, weight: str = "weight") -> DataFrame:
    """macro or weighted mean of per-class values; a class without a value leaves none."""
    any_null = F.max(F.col("value").isNull().cast("int")) == 1
    mean = F.avg("value") if how == "macro" else ratio(F.sum(F.col("value") * F.col(weight)), F.sum(weight).cast("double"))
    return per_class.agg(F.when(~any_null, mean).alias("value"))


def froc_curve(df: DataFrame, n_images: int, n_targets: int, score: str = "score", y: str = "y") -> DataFrame:
    """(threshold, false positives an image, sensitivity) at every score but the lowest."""
    g = running_sums(_score_groups(df, [], score, y), [], [F.desc(score)], {"tp": F.col("p"), "fp": F.col("c") - F.col("p")})
    least = g.agg(F.min(score)).first()[0]
    return g.where(F.col(score) > F.lit(least)).select(F.col(score).alias("threshold"), (F.col("fp") / n_images).alias("fps"), (F.col("tp") / n_targets).alias("sensitivity"))


def froc_score(curve: list[tuple[float, float]], at: tuple[float, ...] = (0.25, 0.5, 1, 2, 4, 8)) -> float:
    """Mean sensitivity at given false positives an image, by interpolation along the curve (fps, sensitivity)."""
    import numpy as np

    points = sorted([*curve, (0.0, 0.0)])
    return float(np.mean(np.interp(at, [p[0] for p in points], [p[1] for p in points])))


def cumulative_average(df: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Weighted mean of finite values; others leave both sum and count."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*by).agg(ratio(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w))).alias("value"), F.sum(F.when(ok, w)).alias("count"))


def variance_metric(df: DataFrame, by: list[str], value: str, floor: float) -> DataFrame:
    """Population variance over repeats and channels; values of zero or less count as ``floor``."""
    return df.groupBy(*by).agg(F.var_pop(F.when(F.col(value) <= 0, F.lit(floor)).otherwise(F.col(value))).alias("value"))


def vector_sums(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """For each group: count, per-dimension sums and sums of squares, one row for each dimension."""
    rows = df.select(*by, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy(*by, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.var_samp("x").alias("var"))


def mmd_linear(df: DataFrame, side: str, vector: str) -> DataFrame:
    """Unbiased squared maximum mean discrepancy of two sides (0 and 1) with the dot-product kernel, in one pass."""
    d = vector_sums(df, [side], vector)
    per = d.groupBy("dim").agg(*[F.max(F.when(F.col(side) == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "s", "ss")])
    xx = F.sum(F.col("s0") * F.col("s0") - F.col("ss0")) / (F.max("n0") * (F.max("n0") - 1))
    yy = F.sum(F.col("s1") * F.col("s1") - F.col("ss1")) / (F.max("n1") * (F.max("n1") - 1))
    return per.agg((xx + yy - 2 * F.sum(F.col("s0") * F.col("s1")) / (F.max("n0") * F.max("n1"))).alias("value"))


def frechet_diagonal(df: DataFrame, side: str, vector: str) -> DataFrame:
    """Frechet distance of two sides with diagonal covariances."""
    d = vector_sums(df, [side], vector)
    per = d.groupBy("dim").agg(*[F.max(F.when(F.col(side) == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "s", "var")])
    gap = F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")
    return per.agg(F.sum(gap * gap + F.col("var0") + F.col("var1") - 2 * F.sqrt(F.col("var0") * F.col("var1"))).alias("value"))


def frechet_distance(mean_a, cov_a, mean_b, cov_b) -> float:
    """Frechet distance of two Gaussians; the root is taken of the symmetric A^1/2 B A^1/2."""
    import numpy as np

    w, v = np.linalg.eigh(cov_a)
    root = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cov_b @ root), 0, None)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * cross)


def frechet_full(df: DataFrame, side: str, vector: str, dims: int) -> DataFrame:
    """Frechet distance with full covariances: sums of products are aggregated by blocks of rows, the d x d root is taken on the driver."""
    import numpy as np
    import pyarrow as pa

    def sums(it):
        acc = {k: [0, np.zeros(dims), np.zeros((dims, dims))] for k in (0, 1)}
        for batch in it:
            x, s = np.array(batch.column("v").to_pylist(), float).reshape(-1, dims), np.asarray(batch.column("s"))
            for k in (0, 1):
                part = x[s == k]
                acc[k][0] += len(part)
                acc[k][1] += part.sum(axis=0)
                acc[k][2] += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([acc[k][0] for k in (0, 1)], pa.int64()), pa.array([acc[k][1].tolist() + acc[k][2].ravel().tolist() for k in (0, 1)], pa.list_(pa.float64()))], ["s", "n", "v"])

    parts = df.select(F.col(side).cast("int").alias("s"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(sums, "s int, n long, v array<double>")
    total = parts.select("s", "n", F.posexplode("v").alias("i", "x")).groupBy("s", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("s", "i").collect()  # 2 (d + d^2) numbers
    out = {}
    for k in (0, 1):
        n = next(r.n for r in total if r.s == k)
        v = np.array([r.x for r in total if r.s == k])
        mean = v[:dims] / n
        out[k] = (mean, (v[dims:].reshape(dims, dims) - n * np.outer(mean, mean)) / (n - 1))
    return df.sparkSession.createDataFrame([(frechet_distance(*out[0], *out[1]),)], "value double")


def panoptic(df: DataFrame, gt: str, pred: str, threshold: float = 0.5) -> DataFrame:
    """Panoptic quality of two labellings of cells, from their contingency table; matches are strictly above the threshold."""
    cells = df.groupBy(gt, pred).agg(F.count("*").alias("inter"))
    a, b = cells.groupBy(gt).agg(F.sum("inter").alias("ga")), cells.groupBy(pred).agg(F.sum("inter").alias("pa"))
    m = cells.where((F.col(gt) != 0) & (F.col(pred) != 0)).join(a, gt).join(b, pred)
    m = m.withColumn("iou", F.col("inter") / (F.col("ga") + F.col("pa") - F.col("inter"))).where(F.col("iou") > threshold)
    hits = m.agg(F.count("*").alias("tp"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou_sum"))
    n = cells.agg(F.countDistinct(F.when(F.col(gt) != 0, F.col(gt))).alias("n_gt"), F.countDistinct(F.when(F.col(pred) != 0, F.col(pred))).alias("n_pred"))
    x = hits.withColumn("__one", F.lit(1)).join(n.withColumn("__one", F.lit(1)), "__one")  # one row each
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    rq = F.col("tp") / F.nullif(F.col("tp") + fp / 2 + fn / 2, F.lit(0.0))
    sq = F.col("iou_sum") / (F.col("tp") + 1e-6)
    return x.select("tp", fp.alias("fp"), fn.alias("fn"), F.coalesce(rq, F.lit(0.0)).alias("rq"), sq.alias("sq"), (F.coalesce(rq, F.lit(0.0)) * sq).alias("pq"))


def nearest_distance(points: DataFrame, others: DataFrame, by: list[str], at: str) -> DataFrame:
    """Distance of each position to the nearest of the other set on a line, by two running extremes instead of a join of all pairs."""
    both = points.select(*by, F.col(at).alias("x"), F.lit(1).alias("own")).unionByName(others.select(*by, F.col(at).alias("x"), F.lit(0).alias("own")))
    w = Window.partitionBy(*by).orderBy("x")
    other = F.when(F.col("own") == 0, F.col("x"))
    left = F.max(other).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(other).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    d = F.least(F.col("x") - left, right - F.col("x"))
    return both.withColumn("distance", d).where("own = 1").select(*by, F.col("x").alias(at), "distance")
