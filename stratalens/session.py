"""Session defaults shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "stratalens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; a running session is reused as it is."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return importable(b.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package wherever the driver was started; on a cluster ship it with --py-files.

    Batches sent to Python are cut to 2,000 rows and 2 MB unless the session has sizes of its own: rows here hold whole texts,
    and a batch stands several times in the memory of an executor and its worker.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, "2000")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, "2147483647") == "2147483647":
        spark.conf.set(size, "2m")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder; the path goes through Spark's own readers only."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
