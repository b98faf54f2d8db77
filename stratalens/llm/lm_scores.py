"""Language-model scores with stupid backoff, computed relationally (operator 10).

The model of a document is the n-gram counts of all *other* documents: from the corpus' counts of
n-grams of up to ``ORDER`` words the document's own are taken away (leave-one-out). Otherwise every
n-gram of a document would be known from the document itself and nothing ever back off. A word's score is

    S(w | context) = count(context w) / count(context)   if the n-gram stands elsewhere (``least`` times or more),
                     0.4 x S(w | shorter context)         otherwise; at last count(w) / words elsewhere,
                                                          and 0.4 / words elsewhere for a word that stands nowhere else,

and a document's is the sum of their logarithms. Copies of a document are other documents.

Count tables are partitioned by hash: the top bits of an n-gram's 64-bit hash name its bucket. A block
of documents explodes its n-grams, sums equal ones, and sends each bucket the sorted keys (as byte
planes of their differences) with its counts. A bucket sums the counts of a key over all blocks and
joins the sums back to the blocks' keys. So a key reaches its bucket once for each block, however
frequent it is. The answers meet the block's texts again, where each word's n-grams pick up their
counts and are summed per document. The chance that any two of a million n-grams share a hash is 3 in 10^8.

Blocks are cut from partitions as they are read; unless the plan only reads and projects files, it is
written to the shared folder first, so that a second reading cuts the same blocks. An answer that
finds no block is an error.

Words are as written. Null and empty texts: no words, log_score 0, mean_log_score and perplexity null.
Repeated rows count as often as they stand there. A null doc_id is carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import batches, doc_rows, forget, input_bytes, materialise, mix, slices, words

ORDER, BACKOFF, LEAST = 3, 0.4, 1
#: Bytes of text of a block, bytes of stored input that meet in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20
#: Bits of a block's number below its home.
HOME_SHIFT = 44

_CODEC = pa.Codec("zstd", 3)
_rng = np.random.default_rng(0x10A)
_PLACE = _rng.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def grams(h: np.ndarray, woff: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hashes of all n-grams, and for each n the number of the n-gram that ends at each word, -1 where the text has none)."""
    n = len(h)
    place = np.arange(n) - np.repeat(woff[:-1], np.diff(woff))
    keys, ends, base = [], [], 0
    acc = np.zeros(n, np.uint64)
    for o in range(order):
        acc[o:] += h[: n - o] * _PLACE[o]
        ok = place >= o
        end = np.full(n, -1, np.int64)
        end[ok] = base + np.arange(int(ok.sum()))
        keys.append(mix(acc[ok] + np.uint64(o + 1)))
        ends.append(end)
        base += int(ok.sum())
    return np.concatenate(keys), ends


def pack(x: np.ndarray, even: int = 0) -> bytes:
    """Whole numbers as byte planes, lowest first: ``even`` low planes, which hold noise, as they are, the others compressed."""
    n = len(x)
    width = max(even, (int(x.max()).bit_length() + 7) // 8) if n else even
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return struct.pack("<IBB", n, width, even) + raw[: even * n] + _CODEC.compress(raw[even * n :], asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n, width, even = struct.unpack_from("<IBB", raw)
    body = raw[6 : 6 + even * n] + _CODEC.decompress(raw[6 + even * n :], (width - even) * n, asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return out.view("<u8")[:, 0]


class Block:
    """Documents read together: their words, n-gram keys and place among the blocks."""

    def __init__(self, seq: int, ids: list[pa.Array], texts: list[np.ndarray], lengths: list[np.ndarray], h: list[np.ndarray], n_words: list[np.ndarray], order: int, bucket_bits: int, homes: int = 1, stride: int = 1) -> None:
        self.ids = pa.concat_arrays(ids)
        self.texts, self.lengths = texts, np.concatenate(lengths)
        self.h = np.concatenate(h)
        self.woff = np.concatenate([[0], np.cumsum(np.concatenate(n_words))])
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        check = np.add.reduce(self.h * (np.arange(len(self.h), dtype=np.uint64) | np.uint64(1))) if len(self.h) else np.uint64(0)
        low = int((mix(np.array([part << 24 | seq], np.uint64)) ^ mix(np.array([check], np.uint64)))[0])
        # The blocks of a partition go to homes next to each other, so all homes get about as many.
        self.number = (part * stride + seq) % homes << HOME_SHIFT | low & (1 << HOME_SHIFT) - 1
        self.order, self.bits = order, bucket_bits

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(sorted distinct keys, counts, number of each n-gram's key, n-grams that end at each word)."""
        keys, ends = grams(self.h, self.woff, self.order)
        by = np.argsort(keys)
        s = keys[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        number = np.empty(len(s), np.int32)
        number[by] = np.cumsum(new) - 1
        return s[at], np.diff(np.append(at, len(s))), number, ends


def blocks(it: Iterator[pa.RecordBatch], order: int, bucket_bits: int, with_text: bool, homes: int = 1, stride: int = 1) -> Iterator[Block]:
    held: list[list] = [[], [], [], [], []]
    size = seq = 0
    for rows, buf, off in batches(it, "text"):
        h, woff = words(buf, off)
        for into, x in zip(held, (rows.column("doc_id"), buf.copy() if with_text else None, np.diff(off), h, np.diff(woff)), strict=True):
            into.append(x)
        size += len(buf)
        if size >= BLOCK_BYTES:
            yield Block(seq, *held, order, bucket_bits, homes, stride)
            held, size, seq = [[], [], [], [], []], 0, seq + 1
    if held[0]:
        yield Block(seq, *held, order, bucket_bits, homes, stride)


def _ask(it: Iterator[pa.RecordBatch], order: int, bits: int, homes: int = 1, stride: int = 1) -> Iterator[pa.RecordBatch]:
    for b in blocks(it, order, bits, False, homes, stride):
        keys, counts, _, _ = b.table()
        if not len(keys):
            continue
        rest = 64 - bits
        bucket = (keys >> np.uint64(rest)).astype(np.int32)
        low = keys & np.uint64((1 << rest) - 1)
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(keys))
        starts = np.append(0, ends[:-1])
        step = np.diff(low, prepend=np.uint64(0))
        step[starts] = low[starts]
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[starts]),
                pa.array(np.full(len(ends), b.number), pa.int64()),
                pa.array([pack(step[i:j], max(0, (rest - (j - i).bit_length()) // 8)) for i, j in spans], pa.binary()),
                pa.array([pack(counts[i:j]) for i, j in spans], pa.binary()),
            ],
            ["bucket", "block", "keys", "counts"],
        )


def _answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each key over the blocks of a bucket, back to each block in the order of its keys."""

    def joined(rows: list[dict]) -> pa.RecordBatch:
        keys = [np.cumsum(unpack(r["keys"]), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        s = every[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        counts = np.concatenate([unpack(r["counts"]) for r in rows])[by]
        sums = np.add.reduceat(counts, np.flatnonzero(new))
        out = np.empty(len(s), np.uint64)
        out[by] = sums[np.cumsum(new) - 1]
        parts = [pack(x) for x in np.split(out, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int64()), pa.array(parts, pa.binary())], ["bucket", "block", "sums"])

    held: list[dict] = []
    for batch in it:
        for r in batch.to_pylist():
            if held and r["bucket"] != held[0]["bucket"]:
                yield joined(held)
                held = []
            held.append(r)
    if held:
        yield joined(held)


def _pack(it: Iterator[pa.RecordBatch], order: int, bits: int, homes: int, stride: int) -> Iterator[pa.RecordBatch]:
    """Each block's documents as one row."""
    for b in blocks(it, order, bits, True, homes, stride):
        ids = np.asarray(b.ids.fill_null(0)).astype("<i8").tobytes()
        row = [[b.number], [ids], [np.asarray(b.ids.is_null()).astype(np.uint8).tobytes()], [b.lengths.astype("<i8").tobytes()], [_CODEC.compress(b"".join(x.tobytes() for x in b.texts), asbytes=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], ["block", "ids", "no_id", "lengths", "texts"])


def own_counts(number: np.ndarray, ends: list[np.ndarray], doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """For each order, how often the n-gram that ends at a word stands in the word's own document (0 where none ends)."""
    out = []
    for end in ends:
        own = np.zeros(len(end), np.int64)
        at = np.flatnonzero(end >= 0)
        if len(at):
            pair = number[end[at]].astype(np.int64) * n_docs + doc[at]
            by = np.argsort(pair, kind="stable")
            p = pair[by]
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            n = np.diff(np.append(first, len(p)))
            own[at[by]] = np.repeat(n, n)
        out.append(own)
    return out


def log_scores(sums: np.ndarray, number: np.ndarray, ends: list[np.ndarray], own: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(log score of each word but for the number of words elsewhere where a word backs off to itself, order of the n-gram that it took; 0 for a word that stands nowhere else).

    ``sums`` are the corpus counts of the block's keys, ``ends`` tells which n-gram ends at each word, ``own`` how often it stands in the document.
    """
    n = len(ends[0])
    out, took, done = np.zeros(n), np.zeros(n, np.int8), np.zeros(n, bool)
    for o in range(len(ends) - 1, -1, -1):
        there = ~done & (ends[o] >= 0)
        at = np.flatnonzero(there)
        count = sums[number[ends[o][at]]] - own[o][at]
        ok = count >= (least if o else 1)
        hit = at[ok]
        out[hit] += np.log(count[ok])
        if o:
            # The context is the n-gram of one word less that ends a word earlier; elsewhere it stands at least as often.
            out[hit] -= np.log(sums[number[ends[o - 1][hit - 1]]] - own[o - 1][hit - 1])
        out[at[~ok]] += np.log(BACKOFF)
        took[hit] = o + 1
        done[hit] = True
    return out, took


def _sum(it: Iterator[pa.RecordBatch], order: int, bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its texts first, then the answers by bucket."""

    def scored(block: dict, answers: list[bytes]) -> pa.RecordBatch:
        ids, none = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["no_id"], np.uint8)
        off = np.concatenate([[0], np.cumsum(np.frombuffer(block["lengths"], np.int64))])
        buf = np.frombuffer(_CODEC.decompress(block["texts"], int(off[-1]), asbytes=True), np.uint8)
        b = object.__new__(Block)
        parts, i = [], 0
        n_words = np.zeros(len(ids), np.int64)
        for i, j in slices(off):
            h, woff = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append(h)
            n_words[i:j] = np.diff(woff)
        b.h, b.woff, b.order, b.bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(n_words)]), order, bits
        keys, _, number, ends = b.table()
        sums = np.concatenate([unpack(x) for x in answers]) if answers else np.zeros(0, np.uint64)
        if len(sums) != len(keys):
            raise RuntimeError("answers don't match a block: the input was read in another order the second time")
        doc = np.repeat(np.arange(len(ids)), n_words)
        logs, took = log_scores(sums.astype(np.int64), number, ends, own_counts(number, ends, doc, len(ids)), least)
        by_order = [np.bincount(doc[took == o], minlength=len(ids)) for o in range(order + 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=none.astype(bool)), pa.array(n_words), pa.array(np.bincount(doc, logs, len(ids))), pa.array(np.stack(by_order, axis=1).tolist(), pa.list_(pa.int64()))],
            ["doc_id", "n_words", "log_part", "by_order"],
        )

    block, answers = None, []
    for batch in it:
        for r in batch.to_pylist():
            if block is not None and r["block"] != block["block"]:
                yield scored(block, answers)
                block, answers = None, []
            if r["texts"] is not None:
                block = r
            elif block is None:
                raise RuntimeError("an answer without its block: the input was read in another order the second time")
            else:
                answers.append(r["sums"])
    if block is not None:
        yield scored(block, answers)


def _only_reads(rows: DataFrame) -> bool:
    """Whether a plan projects and filters one file scan, and so cuts the same blocks whenever it runs."""
    plan = rows._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def lm_scores(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score (natural), mean_log_score, perplexity, by_order (words scored by no, by 1-, 2-, ... grams) of each document; n-grams of two words or more count from ``least`` occurrences elsewhere on."""
    rows, own = doc_rows(docs), None
    if not _only_reads(rows):
        rows = own = materialise(rows, "documents")
    size = max(8, input_bytes(docs) // BUCKET_BYTES)
    bits = min(30, (size - 1).bit_length())  # a bucket's number is an int; 2^30 buckets of 4 MB are 4 PiB
    parts = min(1 << bits, 20_000)  # partitions only: a task takes one bucket after the other
    homes = int(min(20_000, size))  # partitions only: a task takes one block after the other
    stride = -(-homes // max(1, rows._jdf.queryExecution().toRdd().getNumPartitions()))
    asked = rows.mapInArrow(lambda it: _ask(it, order, bits, homes, stride), "bucket int, block long, keys binary, counts binary")
    answers = asked.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(_answer, "bucket int, block long, sums binary")
    texts = rows.mapInArrow(lambda it: _pack(it, order, bits, homes, stride), "block long, ids binary, no_id binary, lengths binary, texts binary")
    both = texts.unionByName(answers, allowMissingColumns=True)
    both = both.repartitionById(homes, F.shiftrightunsigned("block", HOME_SHIFT).cast("int")).sortWithinPartitions("block", F.col("bucket").asc_nulls_first())
    part = materialise(both.mapInArrow(lambda it: _sum(it, order, bits, least), "doc_id long, n_words long, log_part double, by_order array<long>"), "scores")
    if own is not None:
        forget(own)
    total = part.agg(F.sum("n_words")).first()[0] or 0
    elsewhere = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
    log_score = F.col("log_part") - (F.col("by_order")[0] + F.col("by_order")[1]) * F.log(elsewhere)
    some = F.col("n_words") > 0
    mean = F.when(some, log_score / F.col("n_words"))
    return part.select("doc_id", "n_words", F.round(log_score, 6).alias("log_score"), F.round(mean, 9).alias("mean_log_score"), F.round(F.exp(-mean), 6).alias("perplexity"), "by_order")
