"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_folders: set[str] = set()
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="stratalens-"))
        found = _own[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application, which is deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/stratalens/core-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(delete, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


@contextmanager
def scope() -> Iterator[None]:
    """What is written inside goes when it ends: collect or write the results before. Scopes may be nested."""
    made: list[tuple[SparkSession, str]] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for spark, path in made:
            delete(spark, path)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows written as Parquet and read again: what partition ids or samples decided stays decided, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        if getattr(df, "_written", None):
            delete(df.sparkSession, df._written)


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception as e:  # the driver's JVM may have ended
        logging.getLogger(__name__).info("left %s: %s", path, e)
