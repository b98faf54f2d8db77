"""What the operators have in common: the shared folder, intermediate tables, hot joins and memos."""

from __future__ import annotations

from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.llm import mixing, neardup, sentencepieces
from stratalens.llm import shared as S
from stratalens.session import importable


def session(master: str):
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master, _jsc=jsc))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(session(master))


def test_one_machine_has_a_folder_of_its_own():
    assert S.shared_dir(session("local[4]")).startswith("file://")


def tables(spark) -> set[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{S.shared_dir(spark)}/stratalens/{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(x.getPath().getName()).rsplit("-", 1)[0] for x in fs.listStatus(path)} if fs.exists(path) else set()


def test_intermediate_tables_go(spark, data):
    kept = S.materialise(spark.range(3).toDF("x"), "kept")
    gone = S.materialise(spark.range(3).toDF("x"), "gone")
    S.forget(gone, spark.range(1))
    assert "kept" in tables(spark) and "gone" not in tables(spark) and kept.count() == 3
    before = tables(spark)
    neardup.near_duplicates(spark.read.parquet(f"{data}/documents.parquet"), k=2).count()
    assert tables(spark) - before <= {"profiles", "classes", "edges"}


def test_hot_keys_join_as_others_do(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 700).cast("string")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = S.join_hot(rows, table, ["k"], "n", 3000)
    assert got.columns == ["k", "id", "least"]
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.id, r.least) for r in rows.join(table, "k").collect())


def test_memo_is_bounded():
    m = S.Memo(str.upper, most_bytes=2000)
    assert [m[x] for x in ("a", "b", "a")] == ["A", "B", "A"] and len(m) == 2
    assert m["z" * 100] == "Z" * 100 and "z" * 100 not in m
    for k in range(100):
        m[str(k)]
    assert len(m) < 15


def test_rows_without_ids_and_empty_tables(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(None, "one two"), (None, None), (None, "one two")], "doc_id long, text string")
    got = sentencepieces.digests(df, path).collect()
    assert len(got) == 3 and all(r.doc_id is None for r in got) and sorted(r.n_pieces for r in got)[0] == 0
    assert sentencepieces.digests(df.limit(0), path).count() == 0
    many = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    taken = mixing.mix(many, keep=("text",)).collect()
    assert sum(r.taken for r in taken) == 1800 and len({r.taken for r in taken}) == 2


def test_batches_of_long_texts_are_cut_by_bytes(spark):
    """A batch stands several times in the memory of an executor and its worker."""
    docs = importable(spark).range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 1000).alias("text"))

    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 15_000_000 and max(found) < 3 << 20


def test_a_task_gives_memory_back_before_it_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(S, "release", lambda: calls.append(1))
    part = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * 6)], ["text"])
    assert sum(b.num_rows for b in S.freed(iter([part] * 6))) == 36
    assert len(calls) == 3
