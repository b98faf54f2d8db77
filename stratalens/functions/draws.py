"""Repeatable draws: a function of a seed and a row's key alone, so they don't change with partitions, order or lost executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(key: Column | str, seed: int = 0, salt: str = "") -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of seed, salt and key."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{salt}:"), c.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)


def between(key: Column | str, lo: float, hi: float, seed: int = 0, salt: str = "") -> Column:
    return unit(key, seed, salt) * (hi - lo) + lo


def below(key: Column | str, n: Column | int, seed: int = 0, salt: str = "") -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(unit(key, seed, salt) * n).cast("int")


def happens(key: Column | str, probability: float, seed: int = 0, salt: str = "") -> Column:
    return unit(key, seed, "p" + salt) < probability


def normal(key: Column | str, seed: int = 0, salt: str = "") -> Column:
    """A standard normal number, from two uniform ones."""
    u, v = unit(key, seed, "u" + salt), unit(key, seed, "v" + salt)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
