"""Pipelines of steps on DataFrames: compose, random choice by row, affine fusion, cache points, and a JSON form.

A step is a function of a DataFrame, or a linear step (value x scale + shift on one column), of which
neighbours on one column fuse to a single expression before anything runs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Linear:
    """value x scale + shift on a column; it has an inverse and fuses with its neighbours."""

    column: str
    scale: float = 1.0
    shift: float = 0.0

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.col(self.column) * self.scale + self.shift)

    def then(self, other: Linear) -> Linear:
        return Linear(self.column, self.scale * other.scale, self.shift * other.scale + other.shift)

    def inverse(self) -> Linear:
        return Linear(self.column, 1 / self.scale, -self.shift / self.scale)


@dataclass(frozen=True)
class CachePoint:
    """Materialise what comes before."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.persist()


def fuse(steps: Sequence[Step]) -> list[Step]:
    out: list[Step] = []
    for s in steps:
        if out and isinstance(s, Linear) and isinstance(out[-1], Linear) and out[-1].column == s.column:
            out[-1] = out[-1].then(s)
        else:
            out.append(s)
    return out


def flatten(steps: Sequence) -> list[Step]:
    out: list[Step] = []
    for s in steps:
        out += flatten(s.steps) if isinstance(s, Compose) else [s]
    return out


@dataclass(frozen=True)
class Compose:
    steps: Sequence[Step]

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in fuse(flatten(self.steps)):
            df = s(df)
        return df

    def inverse(self) -> Compose:
        """The way back; every step must have an inverse."""
        return Compose([s.inverse() for s in reversed(flatten(self.steps))])


def pick(key: str, seed: int, weights: Sequence[float]):
    """Number of the choice that a row draws: repeatable from seed and key, in proportion to weights."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / (1 << 30)
    total, at, out = sum(weights), 0.0, F.lit(len(weights) - 1)
    bounds = []
    for w in weights[:-1]:
        at += w / total
        bounds.append(at)
    for i in reversed(range(len(bounds))):
        out = F.when(u < bounds[i], i).otherwise(out)
    return out


@dataclass(frozen=True)
class OneOf:
    """Each row takes one of several column functions (of the column, to the column)."""

    column: str
    choices: Sequence[Callable]
    key: str
    weights: Sequence[float] | None = None
    seed: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        which = pick(self.key, self.seed, self.weights or [1.0] * len(self.choices))
        out = F.col(self.column)
        for i, f in enumerate(self.choices):
            out = F.when(which == i, f(F.col(self.column))).otherwise(out)
        return df.withColumn(self.column, out)


@dataclass(frozen=True)
class SomeOf:
    """Each row takes each function with a probability of its own, in order."""

    column: str
    choices: Sequence[Callable]
    key: str
    probability: float = 0.5
    seed: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        for i, f in enumerate(self.choices):
            take = pick(self.key, self.seed + 1000 * (i + 1), [self.probability, 1 - self.probability]) == 0
            df = df.withColumn(self.column, F.when(take, f(F.col(self.column))).otherwise(F.col(self.column)))
        return df


#: Steps that a JSON pipeline may name.
STEPS: dict[str, Callable[..., Step]] = {
    "linear": Linear,
    "cache": CachePoint,
    "select": lambda columns: lambda df: df.select(*columns),
    "drop": lambda columns: lambda df: df.drop(*columns),
    "where": lambda condition: lambda df: df.where(condition),
    "with": lambda column, sql: lambda df: df.withColumn(column, F.expr(sql)),
    "rename": lambda names: lambda df: df.withColumnsRenamed(names),
    "distinct": lambda columns: lambda df: df.dropDuplicates(columns),
}


def resolve(spec: Mapping | Sequence | object, root: Mapping) -> object:
    """References ``@a::b`` to other parts of the configuration, resolved in depth; a cycle is an error."""

    def go(x, path: tuple[str, ...]):
        if isinstance(x, str) and x.startswith("@"):
            if x in path:
                raise ValueError(f"circular reference {' -> '.join([*path, x])}")
            at = root
            for part in x[1:].split("::"):
                at = at[int(part)] if isinstance(at, Sequence) and re.fullmatch(r"\d+", part) else at[part]
            return go(at, (*path, x))
        if isinstance(x, Mapping):
            return {k: go(v, path) for k, v in x.items()}
        if isinstance(x, Sequence) and not isinstance(x, str):
            return [go(v, path) for v in x]
        return x

    return go(spec, ())


def from_json(text: str) -> Compose:
    """A pipeline ``{"steps": [{"step": name, ...arguments}]}`` with references between its parts; nothing in it is executed as code."""
    root = json.loads(text)
    return Compose([STEPS[s["step"]](**{k: v for k, v in s.items() if k != "step"}) for s in resolve(root["steps"], root)])
