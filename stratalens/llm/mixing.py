"""Mixing sources to target weights (operator 2), in DataFrame operations only.

Each document gets a hash-random key; the order of keys within its source is the order in which the
mix takes it. The key's first digits are its range: sizes are summed by (source, range), a window over
these few sums gives what stands before each range, and a window within (source, range) the rest.
So a source of any share is spread over all its ranges, and the prefix sums are exact. A source's
target T takes its whole order as many times as it fits, then the documents in front up to the word
at which the target is reached: the last document is cut there.

Targets: weights go to sources in code point order (null last), repeating; together they share
``share`` of all sizes; no target is above ``most`` times its source's size, and what a source can't
take is shared anew by weight among the others. That is water filling: T = min(weight x level,
most x size), solved in closed form from the sources in the order of most x size / weight.

A null text has size 0, and documents of size 0 take 0. Rows that agree in doc_id and size are
alike in the order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.shared import WORD, doc_rows, materialise
from stratalens.operators.ordered import positions

WEIGHTS = (5.0, 2.0, 1.0)
#: Hexadecimal digits of a key that name its range: 4096 ranges for each source.
RANGE_DIGITS = 3
#: Sources whose cuts (some 100 bytes each) are sent to all executors; more are joined by a shuffle.
FEW_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target from (source, source_size): one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("full", F.sum("cap").over(fills) - F.col("cap"))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(fills) + F.col("weight"))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    # The level at which sources before this one are full and this one isn't; the right one is the first that this source's cap doesn't stop.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    return s.select("source", "source_size", "weight", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _key(seed: int, text: str | Column) -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit(""))))  # rows without an id are told apart by their texts
    return F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("source").cast("string")))


def _takes(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, keep: tuple[str, ...]) -> DataFrame:
    """Of each document: doc_id, size, source, source_size, target, key, epochs (times that its source is taken whole) and part (words taken after that)."""
    rows = doc_rows(docs, F.col("source").cast("string").alias("source"), *(c for c in keep if c != "text"))
    rows = rows.withColumns({"size": n_words(F.col("text")), "key": _key(seed, F.col("text"))})
    if "text" not in keep:
        rows = rows.drop("text")
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    ranges = ranges.withColumn("before", before)
    wanted = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    ranges = ranges.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    r = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(r, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)).cast("long")
    left = whole - epochs * F.col("source_size") - (F.col("before") + F.col("upto") - F.col("size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return rows.select("doc_id", "size", "source", "source_size", "target", "key", epochs.alias("epochs"), part.alias("part"), *keep)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of each document; ``keep`` names further columns to carry."""
    return _takes(docs, weights, share, most, seed, keep).select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document as often as it is taken whole, and once more cut where the budget ends within it.

    The cut text is its leading words joined by one space; a column n_chars follows it. Documents that
    the mix doesn't reach, and those without words, are left out. The words of a source add up to its
    rounded target, whatever ids repeat or are null.

    Only ids, sources and sizes move until each source's *cut* is known: the last place (key, doc_id, size)
    in its order that is taken beyond whole epochs. A row before it is taken once more, a row behind it isn't.
    Rows at that very place share what is left there, one after the other by text and other columns.
    """
    cols = docs.columns
    takes = _takes(docs, weights, share, most, seed, ())
    place = F.struct("key", F.col("doc_id").cast("long").alias("doc_id"), "size")
    sums = takes.groupBy("source", "key", "doc_id", "size").agg(F.sum("part").alias("part"), F.max("epochs").alias("epochs"))
    cuts = sums.groupBy("source").agg(F.max(F.when(F.col("part") > 0, F.struct(place.alias("at"), "part"))).alias("cut"), F.max("epochs").alias("epochs"))
    cuts = cuts.select(F.col("source").alias("__s"), F.col("cut.at").alias("__cut"), F.col("cut.part").alias("__left"), F.col("epochs").alias("__epochs"))
    # A row for each source: by broadcast as long as they are few, so texts stay where they are; else by a join whose hot sources are split.
    cuts = materialise(cuts, "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= FEW_SOURCES else cuts
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.withColumns({"__size": n_words(text), "__key": _key(seed, text)})
    rows = rows.join(cuts, source.eqNullSafe(F.col("__s"))).withColumn("__place", F.struct(F.col("__key").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__size").alias("size")))
    behind = F.col("__cut").isNull() | (F.col("__place") > F.col("__cut"))
    at_cut = F.col("__cut").isNotNull() & ~behind & ~(F.col("__place") < F.col("__cut"))
    sure = rows.where(~at_cut).withColumn("__part", F.when(behind, F.lit(0)).otherwise(F.col("__size")).cast("long"))
    tied = rows.where(at_cut).withColumn("__rest", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]))))
    tied = positions(tied, [F.col("__s").asc_nulls_first(), F.md5(text), F.col("__rest")], "__at")
    firsts = tied.groupBy("__s").agg(F.min("__at").alias("__first")).withColumnRenamed("__s", "__of")
    tied = tied.join(firsts, F.col("__s").eqNullSafe(F.col("__of")))
    share_left = F.col("__left") - (F.col("__at") - F.col("__first")) * F.col("__size")
    tied = tied.withColumn("__part", F.greatest(F.lit(0), F.least(F.col("__size"), share_left)).cast("long"))
    rows = sure.unionByName(tied.select(*sure.columns))
    rows = rows.withColumn("__taken", F.col("__epochs") * F.col("__size") + F.col("__part")).where("__taken > 0")
    copies = F.transform(F.sequence(F.lit(1), F.expr("cast(__taken div __size as int) + if(__taken % __size > 0, 1, 0)")), lambda i: F.least(F.col("__size"), F.col("__taken") - (i - 1) * F.col("__size")))
    rows = rows.withColumn("__words", F.explode(copies))
    part = F.col("__words") < F.col("__size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " ")
    rows = rows.withColumn("__text", F.when(part, cut).otherwise(F.col("text")))
    made = {"text": F.col("__text")}
    if "n_chars" in cols:
        made["n_chars"] = F.when(part, F.length("__text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return rows.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in cols])
