"""Sources: CSV tables, data lists, NumPy files, binary files by format, generated frames and cached tables."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV table with a header; with a schema nothing is read twice and unused columns aren't parsed."""
    r = spark.read.option("header", True).option("sep", sep)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def stream_csv(spark: SparkSession, path: str, schema: str, files_per_chunk: int = 1) -> DataFrame:
    """CSV files of a folder as a stream, so many files to a chunk."""
    return spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_chunk).schema(schema).csv(path)


def load_datalist(spark: SparkSession, path: str, section: str = "training", base: str = "", keys: Sequence[str] = ("image", "label")) -> DataFrame:
    """Records of a section of a JSON data list; plain strings become ``image``; path columns get the base."""
    raw = spark.read.option("multiLine", True).json(path)
    kind = dict(raw.dtypes)[section]
    items = raw.select(F.explode(section).alias("r"))
    rows = items.select(F.col("r").alias("image")) if kind == "array<string>" else items.select("r.*")
    join = lambda c: F.when(F.col(c).cast("string").startswith("/"), F.col(c)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(c, r"^\./", "")))
    return rows.withColumns({k: join(k) for k in keys if base and dict(rows.dtypes).get(k) == "string"})


def datalist_properties(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path)
    missing = [k for k in keys if k not in raw.columns]
    if missing:
        raise KeyError(f"the data list has no {missing}")
    return raw.select(*keys)


#: Decoders by suffix: bytes to {name: ndarray}. More can be registered where their libraries are installed.
DECODERS: dict[str, Callable[[bytes], dict]] = {}


def register_reader(*suffixes: str):
    def add(f):
        for s in suffixes:
            DECODERS[s.lower().lstrip(".")] = f
        return f

    return add


@register_reader("npy")
def _npy(raw: bytes) -> dict:
    import numpy as np

    return {"data": np.load(io.BytesIO(raw), allow_pickle=False)}


@register_reader("npz")
def _npz(raw: bytes) -> dict:
    import numpy as np

    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


@register_reader("pgm", "ppm")
def _pnm(raw: bytes) -> dict:
    """Binary grey or colour maps."""
    import re

    import numpy as np

    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    w, h, top = int(m[2]), int(m[3]), int(m[4])
    a = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", offset=m.end())
    return {"data": a[: w * h * (3 if m[1] == b"6" else 1)].reshape((h, w, 3) if m[1] == b"6" else (h, w))}


@register_reader("nii")
def _nifti(raw: bytes) -> dict:
    """NIfTI-1 single files: data in array order, affine from the s-form or the voxel sizes."""
    import numpy as np

    end = "<" if int.from_bytes(raw[:4], "little") == 348 else ">"
    dims = np.frombuffer(raw, end + "i2", 8, 40)
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}[int(np.frombuffer(raw, end + "i2", 1, 70)[0])]
    size = np.frombuffer(raw, end + "f4", 8, 76)
    at = int(np.frombuffer(raw, end + "f4", 1, 108)[0])
    slope, inter = np.frombuffer(raw, end + "f4", 2, 112)
    shape = tuple(int(x) for x in dims[1 : dims[0] + 1])
    data = np.frombuffer(raw, end + kind, int(np.prod(shape)), at).reshape(shape, order="F")
    if slope not in (0, 1) or inter:
        data = data * float(slope or 1) + float(inter)
    affine = np.vstack([np.frombuffer(raw, end + "f4", 12, 280).reshape(3, 4), [0, 0, 0, 1]]) if np.frombuffer(raw, end + "i2", 1, 254)[0] > 0 else np.diag([*size[1:4], 1.0])
    return {"data": data, "affine": affine}


TENSOR = "path string, name string, shape array<int>, data array<double>, error string"


def read_arrays(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Arrays of files by suffix as rows (path, name, shape, data in row-major order, error); a file that can't be read is a row with null data and the reason, and the others are read."""
    r = spark.read.format("binaryFile")
    return decode_arrays((r.option("pathGlobFilter", glob) if glob else r).load(path))


def decode_arrays(files: DataFrame) -> DataFrame:
    """The arrays of rows (path, content), as ``read_arrays`` gives them."""
    from stratalens.sources import formats  # noqa: F401  registers its readers

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name = PurePosixPath(p).name.lower()
                f = next((DECODERS[s] for s in sorted(DECODERS, key=len, reverse=True) if name.endswith("." + s)), None)
                error = None if f else "no reader for this kind of file"
                try:
                    found = f(raw.as_py()) if f else {"data": None}
                except Exception as e:
                    found, error = {"data": None}, f"{type(e).__name__}: {e}"
                rows += [(p, k, None if a is None else list(a.shape), None if a is None else a.astype(float).ravel().tolist(), error) for k, a in found.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "name", "shape", "data", "error"])

    return files.select("path", "content").mapInArrow(decode, TENSOR)


def cached(df: DataFrame, folder: str, steps: str) -> DataFrame:
    """A table computed once: Parquet under a key made of the plan's input files (name, length and time of change of each), its schema and the name of the steps."""
    import hashlib

    spark = df.sparkSession
    files, seen = sorted(df.inputFiles()), []
    if files:  # listed by Spark; no content is read
        listed = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        seen = [str(x) for x in listed.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()]
    key = hashlib.md5(json.dumps([files, seen, df.schema.json(), steps]).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(conf).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Frames(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class FrameSource(DataSource):
    """Frames by number: a synthetic camera for batch and streaming, ``options: frames, width, height, per_batch``.

    Frame t is a gradient that moves by one pixel a frame, so tests know every value.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame long, height int, width int, data array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _FrameStream(self.options)


def _frame(t: int, options) -> tuple:
    w, h = int(options.get("width", 4)), int(options.get("height", 3))
    return t, h, w, [(x + y + t) % 256 for y in range(h) for x in range(w)]


class _FrameReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self):
        n = int(self.options.get("frames", 10))
        return [_Frames(i, min(n, i + 100)) for i in range(0, n, 100)]

    def read(self, partition):
        return iter([_frame(t, self.options) for t in range(partition.start, partition.end)])


class _FrameStream(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict):
        end = min(start["frame"] + int(self.options.get("per_batch", 5)), int(self.options.get("frames", 10)))
        return iter([_frame(t, self.options) for t in range(start["frame"], end)]), {"frame": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([_frame(t, self.options) for t in range(start["frame"], end["frame"])])

    def commit(self, end: dict) -> None:
        pass


__all__ = ["DECODERS", "FrameSource", "DataSourceStreamReader", "cached", "datalist_properties", "load_datalist", "read_arrays", "read_csv", "register_reader", "stream_csv"]
