"""Document fingerprints by one-permutation MinHash (operator 4).

Every shingle of five words is hashed once. The top bits of the hash name one of ``BINS`` bins, and
the least hash of each bin is kept. Empty bins are filled by optimal densification: bin j tries the
bins that a fixed hash of (j, attempt) names until one that holds a shingle of its own turns up. Of
each bin only the ``BITS`` low-order bits are stored, two bins to a byte. Two unequal minima agree in them by chance with
probability 2^-BITS, so likeness is (agreeing share - 2^-BITS) / (1 - 2^-BITS), between 0 and 1.

Equal texts have equal fingerprints. A text of one to four words is one shingle. A null text counts
as empty; texts without a word have the fingerprint '', alike to each other (1.0) and to nothing
else (0.0). Rows that share a doc_id are ordered by a hash of their text; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import doc_rows, input_bytes, mix, shingles, slices, text_column, words

BINS, BITS, SHINGLE = 512, 4, 5
#: A range of ids is one task; it holds about so many bytes of stored input.
RANGE_BYTES = 8 << 20


def signatures(buf: np.ndarray, off: np.ndarray, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins low-order bits as uint8, whether a text has any word)."""
    n, shift = len(off) - 1, 64 - int(math.log2(bins))
    h, woff = words(buf, off)
    s, soff = shingles(h, woff, k)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * bins, none, np.uint64)
    cell = np.repeat(np.arange(n), np.diff(soff)) * bins + (s >> np.uint64(shift)).astype(np.int64)
    np.minimum.at(least, cell, s)
    least = least.reshape(n, bins)
    full = least != none
    some = full.any(axis=1)
    out = (least & np.uint64((1 << bits) - 1)).astype(np.uint8)
    row, col = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        src = (mix(np.arange(bins, dtype=np.uint64) + np.uint64(attempt * bins)) % np.uint64(bins)).astype(np.int64)[col]
        hit = full[row, src]
        out[row[hit], col[hit]] = out[row[hit], src[hit]]
        row, col = row[~hit], col[~hit]
    return out, some


def pack(signature: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex of the packed low-order bits; '' for a text without words."""
    flat = np.unpackbits(signature[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(signature), -1) if bits < 8 else None
    packed = np.packbits(flat, axis=1) if bits < 8 else signature
    return [packed[i].tobytes().hex() if some[i] else "" for i in range(len(signature))]


def unpack(fingerprint: str, bits: int = BITS) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    if bits == 8:
        return raw
    flat = np.unpackbits(raw).reshape(-1, bits)
    return np.packbits(np.concatenate([np.zeros((len(flat), 8 - bits), np.uint8), flat], axis=1), axis=1)[:, 0]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected estimate of the Jaccard similarity of rows of signatures."""
    chance = 2.0**-bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def likeness_of(a: str, b: str, bits: int = BITS) -> float:
    """Likeness of two stored fingerprints."""
    if not a or not b:
        return float(a == b)
    return float(likeness(unpack(a, bits)[None], unpack(b, bits)[None], bits)[0])


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint of each document; no row moves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            buf, off = text_column(batch.column("text"))
            for i, j in slices(off):
                sig, some = signatures(buf[off[i] : off[j]], off[i : j + 1] - off[i], bins, bits, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(pack(sig, some, bits), pa.string())], ["doc_id", "fingerprint"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_id_order(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id and sorted, each range followed by the row that comes after it (halo = 1).

    Bounds are approximate percentiles of the ids, one for each range. Only they and the first id of
    each range come to the driver.
    """
    from pyspark.ml.feature import Bucketizer

    rows = doc_rows(docs)
    n = max(2, min(100_000, input_bytes(docs) // RANGE_BYTES))
    ids = rows.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] or []
    splits = [-math.inf, *sorted({float(x) for x in ids}), math.inf]
    n = len(splits) - 1

    def ranged(df: DataFrame) -> DataFrame:
        if n == 1:
            return df.withColumn("range", F.lit(0))
        at = df.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)))
        return Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(at).withColumn("range", F.col("range").cast("int")).drop("at")

    firsts = ranged(rows.select("doc_id")).groupBy("range").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("doc_id")).orderBy("range").collect()
    before = [(firsts[i].doc_id, firsts[i - 1].range) for i in range(len(firsts))]
    halo = F.broadcast(docs.sparkSession.createDataFrame(before or [(None, 0)], "first_id long, before int"))
    sent = ranged(rows).join(halo, F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    places = F.filter(F.array(F.struct(F.col("range"), F.lit(0).alias("halo")), F.struct(F.col("before").alias("range"), F.lit(1).alias("halo"))), lambda x: x["range"].isNotNull())
    return (
        sent.select("doc_id", "text", F.explode(places).alias("p"))
        .select("doc_id", "text", "p.range", "p.halo")
        .repartitionById(n, F.col("range"))
        .sortWithinPartitions("halo", F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))))
    )


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half gives way to the start of the next document), and their likeness."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, x, halo in zip(batch.column("doc_id"), batch.column("text"), batch.column("halo"), strict=True):
            yield i.as_py(), x.as_py() or "", halo.as_py()

    def done(held: list[tuple], nxt: str) -> Iterator[pa.RecordBatch]:
        texts = [t for _, t in held] + [nxt]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
        buf, off = text_column(pa.array(texts + edited, pa.large_string()))
        sigs, somes = [], []
        for i, j in slices(off):
            sig, some = signatures(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            sigs.append(sig)
            somes.append(some)
        sig, some = np.concatenate(sigs), np.concatenate(somes)
        n = len(held)
        own, own_some, nxt_, nxt_some, ed, ed_some = sig[:n], some[:n], sig[1 : n + 1], some[1 : n + 1], sig[n + 1 :], some[n + 1 :]
        alike = lambda a, x, b, y: np.where(x & y, likeness(a, b), (x == y).astype(float))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in held], pa.int64()),
                pa.array([len(t) for _, t in held], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(pack(own, own_some), pa.string()),
                pa.array(pack(ed, ed_some), pa.string()),
                pa.array(alike(own, own_some, ed, ed_some)),
                pa.array(alike(own, own_some, nxt_, nxt_some)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, ended = 0, False
        for batch in it:
            for i, text, halo in rows(batch):
                if ended:
                    continue
                if held and (size > 1 << 20 or halo):
                    yield from done(held, text)
                    held, size = [], 0
                if halo:
                    ended = True
                else:
                    held.append((i, text))
                    size += len(text)

    return in_id_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
