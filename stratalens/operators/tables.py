"""Loading of several tables into one: left-deep joins, row and column selection, defaults, casts, column groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


VALIDATIONS = {"one_to_one": (True, True), "1:1": (True, True), "one_to_many": (True, False), "1:m": (True, False), "many_to_one": (False, True), "m:1": (False, True), "many_to_many": (False, False), "m:m": (False, False)}
HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "cross": "cross"}


def _check_unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the keys of the {side} table are not unique: {twice[0].asDict()}")


def _join_two(left: DataFrame, right: DataFrame, on: Sequence[str] | None, left_on: Sequence[str] | None, right_on: Sequence[str] | None, how: str, suffixes: tuple[str, str], indicator: str | None, validate: str | None) -> DataFrame:
    if how not in HOW:
        raise ValueError(f"unknown kind of join: {how}")
    if how == "cross":
        lk, rk = [], []
    elif left_on or right_on:
        if on or not left_on or not right_on or len(left_on) != len(right_on):
            raise ValueError("give either on, or left_on and right_on of one length")
        lk, rk = list(left_on), list(right_on)
    else:
        lk = rk = list(on) if on else [c for c in left.columns if c in right.columns]
        if not lk:
            raise ValueError("the tables share no column to join on")
    if validate:
        one_left, one_right = VALIDATIONS[validate]
        if one_left:
            _check_unique(left, lk, "left")
        if one_right:
            _check_unique(right, rk, "right")
    shared = [a for a, b in zip(lk, rk, strict=True) if a == b]  # keys of one name are one column
    clash = [c for c in left.columns if c in right.columns and c not in shared]
    a = left.select(*[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns], F.lit(1).alias("__a"))
    b = right.select(*[F.col(c).alias(f"__k_{c}" if c in shared else c + suffixes[1] if c in clash else c) for c in right.columns], F.lit(1).alias("__b"))
    if how == "cross":
        out = a.crossJoin(b)
    else:
        l_name = lambda c: c + suffixes[0] if c in clash else c
        r_name = lambda c: f"__k_{c}" if c in shared else c + suffixes[1] if c in clash else c
        out = a.join(b, reduce(Column.__and__, [F.col(l_name(x)).eqNullSafe(F.col(r_name(y))) for x, y in zip(lk, rk, strict=True)]), HOW[how])
    rest = [c for c in [*a.columns, *b.columns] if c not in shared and not c.startswith("__")]
    cols = [F.coalesce(F.col(c), F.col(f"__k_{c}")).alias(c) if how in ("outer", "full", "right") else F.col(c) for c in shared]
    if indicator:
        rest = [*rest, F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both").alias(indicator)]
    return out.select(*cols, *rest)


def join_tables(
    tables: Sequence[DataFrame],
    on: str | Sequence[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
    indicator: str | None = None,
    left_on: str | Sequence[str] | None = None,
    right_on: str | Sequence[str] | None = None,
    validate: str | None = None,
) -> DataFrame:
    """Left-deep join in the order given; without keys the common columns are the keys, and no common column is an error.

    Null keys match each other, and other columns that both sides have get ``suffixes``, as is usual for
    record tables. Keys of different names (``left_on``, ``right_on``) both stay. ``indicator`` names a
    column with left_only, right_only or both; ``validate`` (1:1, 1:m, m:1, m:m) checks that the keys of a
    side are unique. Only ``how="cross"`` makes all pairs.
    """
    listed = lambda x: [x] if isinstance(x, str) else list(x) if x else None
    return reduce(lambda a, b: _join_two(a, b, listed(on), listed(left_on), listed(right_on), how, suffixes, indicator, validate), tables)


def select_rows(df: DataFrame, index: str, rows: Sequence[int | Sequence[int]], order: str | None = None) -> DataFrame:
    """Rows by label and half-open ranges ``[start, end)`` of an index column, in the order of the list and as often as they are listed.

    ``order`` names a column to hold the place of a row's entry in the list, for sorting the result. The
    condition reaches the scan.
    """
    bounds = [(r, r + 1) if isinstance(r, int) else (r[0], r[1]) for r in rows]
    if not bounds:
        return df.limit(0).withColumn(order, F.lit(0)) if order else df.limit(0)
    inside = [(F.col(index) >= lo) & (F.col(index) < hi) for lo, hi in bounds]
    hit = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda x: x.isNotNull())
    out = df.where(reduce(Column.__or__, inside)).withColumn("__place", F.explode(hit))
    return out.withColumnRenamed("__place", order) if order else out.drop("__place")


def fill_and_cast(df: DataFrame, types: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Defaults first, then casts: ``{"col": {"type": "int", "default": 0}}``."""
    made = {}
    for c, how in types.items():
        x = F.col(c)
        if how.get("default") is not None:
            x = F.coalesce(x, F.lit(how["default"]))
        if how.get("type"):
            x = x.cast(how["type"])
        made[c] = x
    return df.withColumns(made)


def group_columns(df: DataFrame, groups: Mapping[str, Sequence[str]], kind: str = "double") -> DataFrame:
    """One array column for each group of columns, from values that are neither filled nor cast by column."""
    return df.withColumns({name: F.array(*[F.col(c).cast(kind) for c in cols]) for name, cols in groups.items()})


def missing_keys(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows whose key the other table lacks (the check for missing files, as an anti join)."""
    return df.join(known.select(on).distinct(), on, "left_anti")
