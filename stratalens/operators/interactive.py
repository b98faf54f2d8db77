"""Label and guidance transforms of interactive annotation, on dense label arrays and click points of a record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import draws
from stratalens.functions.nd import Nd, product


def valid_slices(label: Nd, above: float = 0.0) -> Column:
    """Numbers of the slices along the first axis that hold any foreground."""
    each = product(label.shape[1:])
    hit = F.transform(F.sequence(F.lit(0), F.lit(label.shape[0] - 1)), lambda k: F.when(F.exists(F.slice(label.data, k * each + 1, F.lit(each)), lambda v: v > above), k))
    return F.filter(hit, lambda k: k.isNotNull())


def fetch_slice(image: Nd, k: Column) -> Nd:
    """One slice along the first axis."""
    each = product(image.shape[1:])
    return Nd(F.slice(image.data, (k * each + 1).cast("int"), F.lit(each)), image.shape[1:])


def discrepancy(label: Column, pred: Column, at: float = 0.5) -> tuple[Column, Column]:
    """(0/1 array of label that the prediction misses, 0/1 array of prediction outside the label)."""
    both = lambda f: F.zip_with(label, pred, lambda a, b: f(a > at, b > at).cast("int"))
    return both(lambda a, b: a & ~b), both(lambda a, b: ~a & b)


def relabel(label: Column, mapping: Mapping[int, int]) -> Column:
    """Labels replaced by a mapping that looks at the original values; others stay."""
    def one(x: Column) -> Column:
        out = x
        for old, new in mapping.items():
            out = F.when(x == old, F.lit(new)).otherwise(out)
        return out

    return F.transform(label, one)


def normalised_labels(names: Mapping[str, int], kept: Sequence[str] | None = None) -> tuple[dict[str, int], dict[int, int]]:
    """(name: new number, old number: new number): labels counted 1, 2, ... in the order of names, background 0; labels that aren't kept become background."""
    new, moved, k = {}, {}, 1
    for name, old in names.items():
        if name == "background" or kept is not None and name not in kept:
            moved[old] = 0
            if name == "background":
                new[name] = 0
            continue
        new[name], moved[old] = k, k
        k += 1
    return new, moved


def select_label(label: Column, key: str, labels: Sequence[int], seed: int = 0) -> tuple[Column, Column]:
    """(drawn label of those that the array holds, the array as 1 for it and 0 else); NULL if it holds none."""
    there = F.array_intersect(F.array(*map(F.lit, labels)), label)
    drawn = F.when(F.size(there) > 0, F.element_at(there, draws.below(key, F.size(there), seed) + 1))
    return drawn, F.transform(label, lambda x: F.coalesce(x == drawn, F.lit(False)).cast("int"))


def split_predictions(df: DataFrame, pred: str, names: Mapping[str, int]) -> DataFrame:
    """A 0/1 column for each named label of a prediction."""
    return df.withColumns({f"{pred}_{n}": F.transform(pred, lambda x: (x == k).cast("int")) for n, k in names.items()})  # noqa: B023


def split_label(label: Column, mask_value: int, others_value: int) -> tuple[Column, Column]:
    """(1 for the cells of one instance, 1 for those of all other instances)."""
    return F.transform(label, lambda x: (x == mask_value).cast("int")), F.transform(label, lambda x: ((x != mask_value) & (x != 0)).cast("int") * others_value)


def seed_point(candidates: Column, key: str, seed: int = 0) -> Column:
    """A drawn element of an array (a position in a label); NULL if it is empty."""
    return F.when(F.size(candidates) > 0, F.element_at(candidates, draws.below(key, F.size(candidates), seed) + 1))


def random_guidance(missed: Column, wrong: Column, key: str, probability: float, seed: int = 0) -> tuple[Column, Column]:
    """(positive, negative) click positions added with a probability: on missed label if there is any, else on wrong prediction."""
    asked = draws.happens(key, probability, seed)
    at = lambda a: F.filter(F.transform(a, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    pos, neg = seed_point(at(missed), key, seed), seed_point(at(wrong), key, seed + 1)
    return F.when(asked, pos), F.when(asked & (F.size(at(missed)) == 0), neg)


def split_clicks(clicks: Column, slice_of) -> Column:
    """Clicks (arrays of coordinates) with the slice that each lies on, as entries {slice: clicks on it}."""
    slices = F.array_sort(F.array_distinct(F.transform(clicks, slice_of)))
    return F.map_from_entries(F.transform(slices, lambda s: F.struct(s.alias("key"), F.filter(clicks, lambda c: slice_of(c) == s).alias("value"))))


def resize_guidance(points: Column, source: Sequence[float], target: Sequence[float]) -> Column:
    """Points moved with an image that is resized, rounded half to even."""
    return F.transform(points, lambda p: F.array(*[F.rint(p[k] * (t / s)).cast("int") for k, (s, t) in enumerate(zip(source, target, strict=True))]))


def guidance_box(points: Column, dims: int, margin: Sequence[int], shape: Sequence[int]) -> dict[str, Column]:
    """The crop around all points with a margin, inside the image: start and exclusive end of each axis."""
    out = {}
    for k in range(dims):
        c = F.transform(points, lambda p: p[k])  # noqa: B023
        out[f"start{k}"] = F.greatest(F.array_min(c) - margin[k], F.lit(0))
        out[f"end{k}"] = F.least(F.array_max(c) + margin[k] + 1, F.lit(shape[k]))
    return out


def shift_guidance(points: Column, start: Sequence[Column]) -> Column:
    """Points as the cropped image sees them."""
    return F.transform(points, lambda p: F.array(*[p[k] - s for k, s in enumerate(start)]))


def prompt_classes(labels: Column, special: Sequence[int], key: str, most: int, seed: int = 0) -> Column:
    """Up to ``most`` drawn classes of those that an array holds, background and special ones left out, in their order."""
    there = F.filter(F.array_sort(F.array_distinct(labels)), lambda x: (x != 0) & ~x.isin(*special) if special else x != 0)
    order = F.array_sort(F.transform(there, lambda x: F.struct(draws.unit(F.concat_ws("/", F.col(key), x), seed).alias("u"), x.alias("x"))))
    return F.array_sort(F.transform(F.slice(order, 1, most), lambda s: s["x"]))


def merge_points(channels: Sequence[Column]) -> Column:
    """Cell by cell the greatest of several dense arrays."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), channels)


def valid_slices_of_labels(label: Nd, names: Mapping[str, int]) -> dict[str, Column]:
    """For each named label the slices along the first axis that hold it."""
    each = product(label.shape[1:])

    def of(k: int) -> Column:
        hit = F.transform(F.sequence(F.lit(0), F.lit(label.shape[0] - 1)), lambda i: F.when(F.array_contains(F.slice(label.data, i * each + 1, F.lit(each)), k), i))
        return F.filter(hit, lambda i: i.isNotNull())

    return {n: of(k) for n, k in names.items()}


def restore_label(label: Nd, cropped: Sequence[int], start: Sequence[Column | int], shape: Sequence[int]) -> Nd:
    """A label of a resized crop back in the original image: nearest cells at the crop's size, at its place, zeros elsewhere."""
    return label.resize_nearest(cropped).paste(shape, start)


def click_patches(df: DataFrame, image: Nd, clicks: str, size: Sequence[int], name: str = "patch") -> DataFrame:
    """A row for each click (array of coordinates): the box of the image about it, zeros outside."""
    rows = df.withColumn("click", F.explode(clicks))
    return rows.withColumn(name, image.around([F.col("click")[k] for k in range(len(size))], size).data)


def click_channels(shape: Sequence[int], inside: Column, others: Column) -> tuple[Column, Column]:
    """(1 at the clicks on an instance, 1 at those on others but not on it), as dense arrays."""
    from stratalens.functions.nd import unravel_index

    def at(i: Column, clicks: Column) -> Column:
        place = F.array(*[c.cast("int") for c in unravel_index(i, shape)])
        return F.array_contains(clicks, place)

    cells = F.sequence(F.lit(0), F.lit(product(shape) - 1))
    return F.transform(cells, lambda i: at(i, inside).cast("int")), F.transform(cells, lambda i: (at(i, others) & ~at(i, inside)).cast("int"))


def argmax_labels(channels: Sequence[Column], ids: Sequence[int], threshold: float = 0.0) -> Column:
    """The label of the channel with the greatest value at each cell, 0 where none is above a threshold; of equal ones the first."""
    best = reduce(lambda a, b: F.zip_with(a, b, lambda s, t: F.when(t["v"] > s["v"], t).otherwise(s)), [F.transform(c, lambda v: F.struct(v.alias("v"), F.lit(k).alias("k"))) for c, k in zip(channels, ids, strict=True)])  # noqa: B023
    return F.transform(best, lambda s: F.when(s["v"] > threshold, s["k"]).otherwise(0))
