"""What the operators of this subpackage have in common.

Words are maximal runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). The numpy
kernel below finds and hashes all words of a slice of an Arrow text column at once, so no Python
object is made for a word.
"""

from __future__ import annotations

import atexit
import ctypes
import logging
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 1 << 20
#: A task gives freed memory back after so many bytes of its rows.
RELEASE_BYTES = 16 << 20

_own: list[str] = []
_folders: set[str] = set()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(0x5EED)
_POWERS = _rng.integers(1 << 62, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[_SPACE] = 0
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers whose bits all depend on each other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64() gives for a column of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = np.full(len(x), int(p5) + 42 + 8, np.uint64)
    h ^= turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def text_column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying; nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    n = len(arr)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each; a longer text is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word with the total at the end)."""
    if len(buf) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    space = _SPACE[buf]
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = True
    first = before & ~space
    starts = np.flatnonzero(first)
    woff = np.searchsorted(starts, off)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), woff
    within = np.arange(len(buf), dtype=np.int32)
    at = np.cumsum(first, dtype=np.int32)
    at -= 1
    np.maximum(at, 0, out=at)
    within -= starts.astype(np.int32)[at]
    within &= 4095
    value = (_BYTES_LOWER if lower else _BYTES)[buf]
    value *= _POWERS[within]
    return mix(np.add.reduceat(value, starts)), woff


class Memo(dict):
    """A worker's memo of a function of strings; bounded by bytes, it starts anew when full, and long strings are never kept."""

    def __init__(self, make, most_bytes: int = 24 << 20, longest: int = 64) -> None:
        self.make, self.most, self.longest, self.size = make, most_bytes, longest, 0

    def __missing__(self, key: str):
        found = self.make(key)
        if len(key) <= self.longest:
            if self.size > self.most:
                self.clear()
                self.size = 0
            self.size += 200 + 4 * len(key)
            self[key] = found
        return found

    def learn(self, keys: Iterable[str], many) -> None:
        """Keep what ``many`` makes of those keys that are missing, all at once, but for long ones. Afterwards none of the others is missing."""
        if self.size > self.most:
            self.clear()
            self.size = 0
        new = [k for k in set(keys) if k not in self and len(k) <= self.longest]
        for key, found in zip(new, many(new), strict=True):
            self.size += 200 + 4 * len(key)
            self[key] = found


def release() -> None:
    """Give memory that a worker has freed back to the system; workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task yields; memory that it has freed goes back to the system when it ends and each time it has yielded RELEASE_BYTES."""
    size = 0
    for batch in it:
        yield batch
        size += batch.nbytes
        if size >= RELEASE_BYTES:
            batch, size = None, 0
            release()
    release()


def batches(it: Iterable[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices of the batches of a partition."""
    for batch in it:
        buf, off = text_column(batch.column(text))
        for i, j in slices(off, size):
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
    release()


def doc_rows(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of what the plan's leaves hold, for choosing numbers of buckets; no job runs. A leaf of unknown size counts as 64 MB."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # another kind of session
        return 1 << 30
    return sum(x if x < 1 << 60 else 64 << 20 for x in sizes)


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Rows with the columns of a table that has one row for each key, and in ``count`` the number of rows that hold the key.

    Keys of more than a thousandth of all rows, a thousand at most, come by broadcast, so their rows stay
    spread as they are; the others by a shuffle.
    """
    large = F.broadcast(table.where(F.col(count) * 1000 > total).drop(count))
    small = table.where(F.col(count) * 1000 <= total).drop(count)
    return rows.join(large, on).unionByName(rows.join(large.select(*on), on, "left_anti").join(small, on))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all run on one machine and the session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="stratalens-"))
        found = _own[0]
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    The table lies in a folder of this application, which goes when the driver ends; ``forget`` deletes it sooner.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stratalens/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the driver's JVM may have ended; what is left is a folder of an ended application
        logging.getLogger(__name__).info("left %s: %s", path, e)


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        if getattr(df, "_written", None):
            _delete(df.sparkSession, df._written)


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, type=kind))


_SHINGLE = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle, index of each text's first one); 0 < words < k give one shingle of them all, no word none."""
    nw = np.diff(woff)
    ns = np.where(nw >= k, nw - k + 1, np.minimum(nw, 1))
    soff = np.concatenate([[0], np.cumsum(ns)])
    if len(h) == 0:
        return np.zeros(0, np.uint64), soff
    acc = h * _SHINGLE[0]
    left = np.repeat(woff[1:], nw) - np.arange(len(h)) - 1
    for j in range(1, k):
        add = h[j:] * _SHINGLE[j]
        add[left[: len(add)] < j] = 0
        acc[: len(add)] += add
    at = np.repeat(woff[:-1] - soff[:-1], ns) + np.arange(soff[-1])
    return mix(acc[at] ^ np.uint64(k)), soff
