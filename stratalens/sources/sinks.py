"""Sinks: CSV rows, metric reports, JSON reports and mappings, arrays as files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_csv(df: DataFrame, path: str, key: str, values: str, delimiter: str = ",", overwrite: bool = False) -> None:
    """A line for each record: its key and the values of an array, all with one delimiter."""
    kind = dict(df.dtypes)[values]
    flat = F.concat_ws(delimiter, F.col(key).cast("string"), F.transform(values, lambda x: x.cast("string")) if kind.startswith("array") else F.col(values).cast("string"))
    df.select(flat.alias("value")).write.mode("overwrite" if overwrite else "append").text(path)


def write_report(raw: DataFrame, summary: DataFrame, folder: str, delimiter: str = "\t") -> None:
    """The raw and summary tables of a metric."""
    for name, df in (("raw", raw), ("summary", summary)):
        df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(f"{folder}/{name}")


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def file_name(path, postfix: str = "", extension: str | None = None, parent: bool = True):
    """Output name for an input path: folder named like the file, postfix before the extension."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.nii)?\.[^.]+$", "")
    ext = F.lit(extension) if extension else F.regexp_extract(path, r"((?:\.nii)?\.[^.]+)$", 1)
    name = F.concat(base, F.lit(f"_{postfix}" if postfix else ""), ext)
    return F.concat(base, F.lit("/"), name) if parent else name


def save_arrays(df: DataFrame, path: str, name: str = "name", suffix: str = "npy") -> DataFrame:
    """(name, content) with each array (shape, data[, affine]) as the bytes of a file of a kind (npy, png, nrrd, nii, nii.gz), written as a table that any store holds."""
    import numpy as np
    import pyarrow as pa

    from stratalens.sources.formats import writer_of

    encode_one = writer_of(f"x.{suffix}")
    with_affine = "affine" in df.columns

    def encode(it):
        for batch in it:
            out = []
            affines = batch.column("affine").to_pylist() if with_affine else [None] * batch.num_rows
            for shape, data, m in zip(batch.column("shape").to_pylist(), batch.column("data").to_pylist(), affines, strict=True):
                n = int(len(m) ** 0.5) if m else 0
                out.append(encode_one(np.asarray(data, float).reshape(shape), np.asarray(m, float).reshape(n, n) if m else None))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])

    cols = [F.col(name).cast("string").alias("name"), "shape", "data", *(["affine"] if with_affine else [])]
    files = df.select(*cols).mapInArrow(encode, "name string, content binary")
    files.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_mapping(df: DataFrame, source: str, target: str, path: str) -> None:
    """The log of which input became which output, as JSON lines; runs add to it."""
    df.select(F.col(source).alias("input"), F.col(target).alias("output")).distinct().write.mode("append").json(path)


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix
