"""A training corpus in five stages, each an operator of stratalens.llm with production parameters.

1. toxicity: documents predicted toxic go.
2. near-dedup: of each component of near duplicates (five-word shingles, similarity 0.8) the least doc_id stays,
   and one row of those that agree in doc_id (null included) and text.
3. substring dedup: words in a 20-word window that also starts earlier are removed; other texts stay as they are.
4. mixing: sources in the proportions of their weights, documents repeated or cut at each source's budget.
5. SentencePiece: ids of every document, and whether they decode to its text.

Each stage reads what its predecessor wrote as Parquet. All but the last return the columns of
documents. Empty tables pass through; null texts are kept as they are (they are neither toxic, near to
anything nor repeated) until the mix, which takes no document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import mixing, neardup, recompression, sentencepieces, toxicity
from stratalens.llm.queries import vocabulary
from stratalens.llm.shared import forget, materialise
from stratalens.session import read_table

#: SQL can't express the learnt lexicon, the confirmed components or the encoder; tests hold the rows against brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")) if rest else docs.select("doc_id", "text", F.struct(F.lit(0).alias("none")).alias("rest"))


def _columns(docs: DataFrame, **made) -> list:
    return [made.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(_packed(docs), *model, keep=("text", "rest"))
    return scored.where("predicted = 0").select(_columns(docs))


def _once(docs: DataFrame) -> DataFrame:
    """One row of those that agree in doc_id (null included) and text, the least by the JSON of its other columns; null texts as they are."""
    some = _packed(docs.where("text is not null")).groupBy("doc_id", "text").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
    return some.select(_columns(docs)).unionByName(docs.where("text is null"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.near_duplicates(docs, k=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return _once(docs).join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(_packed(docs), keep=("text", "rest"))
    cut = F.col("n_removed") > 0
    made = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("rest.n_chars"))
    return out.select(_columns(docs, **made))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode_decode(_packed(docs), vocabulary("piece_bpe_32k.model"), keep=("text", "rest"))
    return out.select(*_columns(docs), "ids", F.size("ids").alias("n_pieces"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
