"""Record transforms on named columns; columns that are not named pass through."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_items(df: DataFrame, keys: Sequence[str], allow_missing: bool = False) -> DataFrame:
    return df.select(*[k for k in keys if not allow_missing or k in df.columns])


def delete_items(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop columns; ``a.b`` drops a field of a struct."""
    for k in keys:
        head, _, tail = k.partition(".")
        df = df.withColumn(head, F.col(head).dropFields(tail)) if tail else df.drop(head)
    return df


def copy_items(df: DataFrame, keys: Sequence[str], times: int, names: Sequence[str]) -> DataFrame:
    if len(names) != len(keys) * times:
        raise ValueError("there must be a name for each copy of each key")
    return df.withColumns({names[i * len(keys) + j]: F.col(k) for i in range(times) for j, k in enumerate(keys)})


def concat_items(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Array columns joined end to end, other columns gathered in an array."""
    kinds = dict(df.dtypes)
    parts = [F.col(k) if kinds[k].startswith("array") else F.array(F.col(k)) for k in keys]
    return df.withColumn(name, F.concat(*parts))


def flatten_sub_keys(df: DataFrame, key: str, sub: Sequence[str], delete: bool = True, prefix: str | None = None) -> DataFrame:
    """Fields of a struct column as columns, ``prefix_field`` if a prefix is given; a name that is taken is an error."""
    taken = [n for s in sub if (n := f"{prefix}_{s}" if prefix else s) in df.columns and not (delete and n == key)]
    if taken:
        raise ValueError(f"columns {taken} exist already")
    out = df.withColumns({(f"{prefix}_{s}" if prefix else s): F.col(f"{key}.{s}") for s in sub})
    return out.drop(key) if delete else out


def map_labels(c: Column, mapping: Mapping[object, object]) -> Column:
    """All replacements look at the original value; others stay."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def label_filter(c: Column, applied: Sequence[object], fill: object = 0) -> Column:
    """Labels of a list stay, others become ``fill``."""
    return F.when(c.isin(list(applied)), c).otherwise(F.lit(fill))


def label_to_mask(c: Column, selected: Sequence[object]) -> Column:
    return c.isin(list(selected)).cast("int")


def cast_clamped(c: Column, kind: str) -> Column:
    """Cast to an integer kind after clamping to its range."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind]
    lo, hi = -(1 << bits - 1), (1 << bits - 1) - 1
    return F.greatest(F.least(c, F.lit(float(hi) if bits < 64 else float(hi) - 1024)), F.lit(float(lo))).cast(kind)


def remove_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose whole name a regular expression matches."""
    import re

    return df.drop(*[c for c in df.columns if re.fullmatch(pattern, c)])


def sorted_map(c: Column) -> Column:
    """A map with its entries in the order of keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def flatten_struct(df: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """All leaves of a nested struct as columns named by their path."""
    from pyspark.sql.types import StructType

    out: dict[str, Column] = {}

    def walk(kind, path: list[str]) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, StructType):
                walk(f.dataType, [*path, f.name])
            else:
                out[separator.join([*path, f.name])] = reduce(lambda c, n: c.getField(n), [*path[1:], f.name], F.col(f"`{path[0]}`"))

    walk(df.schema[column].dataType, [column])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *[v.alias(k) for k, v in out.items()])


def pairs_to_map(c: Column, separator: str = "=") -> Column:
    """A map from an array of name=value strings; the last of equal names counts."""
    split = F.transform(c, lambda s: F.struct(F.substring_index(s, separator, 1).alias("k"), F.when(F.instr(s, separator) > 0, F.substring(s, F.instr(s, separator) + len(separator), F.length(s))).alias("v")))
    last = F.filter(split, lambda e, i: ~F.exists(F.slice(split, i + 2, F.greatest(F.size(split) - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def label_union(a: Column, b: Column) -> Column:
    """Sorted labels of two arrays, each once."""
    return F.array_sort(F.array_union(a, b))


#: Metres in a unit, by its name and by its prefix.
LENGTHS = {"meter": 1.0, "inch": 0.0254, "foot": 0.3048, "yard": 0.9144, "mile": 1609.344}
PREFIXES = {"peta": 1e15, "tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 1e1, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12, "femto": 1e-15}


def unit_factor(source: str, target: str) -> float:
    """What a value in one unit of length is multiplied with to be in another (millimeter, inch, ...)."""

    def metres(unit: str) -> float:
        if unit in LENGTHS:
            return LENGTHS[unit]
        for prefix, x in PREFIXES.items():
            if unit.startswith(prefix) and unit[len(prefix) :] in LENGTHS:
                return x * LENGTHS[unit[len(prefix) :]]
        raise ValueError(f"unknown unit {unit}")

    return metres(source) / metres(target)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """Edits that turn one string into another: letters left out, put in, changed, or two neighbours exchanged (optimal string alignment).

    Rows of the distance table run through an aggregate over the first string's letters.
    """
    x, y = F.split(a, ""), F.split(b, "")
    x, y = F.filter(x, lambda c: c != ""), F.filter(y, lambda c: c != "")
    n = F.size(y)
    first = F.transform(F.sequence(F.lit(0), n), lambda j: j)
    start = F.struct(first.alias("last"), first.alias("older"), F.lit(0).alias("i"), F.lit("").alias("c"))

    def step(s: Column, c: Column) -> Column:
        def put(row: Column, d: Column, j: Column) -> Column:
            change = F.element_at(s["last"], j + 1) + (d != c).cast("int")
            best = F.least(F.element_at(s["last"], j + 2) + 1, F.element_at(row, -1) + 1, change)
            swapped = (s["i"] > 0) & (j > 0) & (s["c"] == d) & (F.when(j > 0, F.element_at(y, F.greatest(j, F.lit(1)))) == c)
            return F.concat(row, F.array(F.when(F.coalesce(swapped, F.lit(False)), F.least(best, F.element_at(s["older"], F.greatest(j, F.lit(1))) + 1)).otherwise(best)))

        places = F.transform(y, lambda d, j: F.struct(d.alias("d"), j.alias("j")))
        row = F.aggregate(places, F.array(s["i"] + 1), lambda r, p: put(r, p["d"], p["j"]))
        return F.struct(row.alias("last"), s["last"].alias("older"), (s["i"] + 1).alias("i"), c.alias("c"))

    return F.aggregate(x, start, step, lambda s: F.element_at(s["last"], -1))
