"""Mining of phrases by Rabin-Karp fingerprints (operator 13).

Texts are lower-cased (A-Z), cut at ``. , ; : ! ?`` and line ends into pieces and these at blanks and
tabs into words. Everything is counted for each language. A phrase of 2 to ``longest`` words that
occurs ``least`` times or more (overlaps count) is a candidate; its score is that of its weakest cut
into two parts, occurrences squared over the product of the parts' occurrences. A candidate inside a
longer candidate with at least half its occurrences is dropped. The ``top`` best of each language stay.

1. A block of documents hashes its words and takes prefix polynomials of them modulo 2^64; differences
   of prefixes, divided by the power of the place, are the fingerprints of all n-grams within pieces,
   salted by language. Equal ones combine, and each bucket (top bits) gets the block's sorted
   fingerprints with their counts.
2. A bucket adds the counts of a fingerprint over all blocks and answers each block with one bit for
   each: whether ``least`` occurrences are reached. So a phrase meets itself once for each block, however
   frequent it is.
3. Answers meet the block's texts again. The place of first occurrence of a fingerprint in the block
   points to its words; every other occurrence is compared with it, word for word, and words byte for byte.
   Only frequent fingerprints are written out as phrases.
4. Phrases, not fingerprints, are then summed over blocks, with a partial sum in each task; those below
   ``least`` are collisions of fingerprints and go. So collisions cost room, never results.
5. Parts and longer phrases are joined by phrase; exact decimals of 38 digits make the scores.

Blocks are cut from partitions as they are read; a plan that does more than read files is written to the
shared folder first, so that the second reading cuts the same blocks. An answer that finds no block is an error.

Null texts are empty and texts without words count nothing; a null language is ``und``. Repeated rows count
as often as they stand there; ids and other columns don't matter. No candidates give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.lm_scores import HOME_SHIFT, _only_reads, pack, unpack
from stratalens.llm.shared import _BYTES_LOWER, _POWERS, batches, forget, input_bytes, materialise, mix, release, slices

LEAST, LONGEST, TOP, WITHIN = 10, 3, 2000, 50
#: Bytes of text of a block, bytes of stored input that meet in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20

#: Base of the polynomials, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(BASE, -1, 1 << 64)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODEC = pa.Codec("zstd", 3)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def split(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, document, piece) of the words of lower-cased texts; words of one piece share the number of breaks and documents before them."""
    apart = _APART[buf]
    before = np.append(True, apart[:-1])
    before[off[:-1][off[:-1] < len(buf)]] = True
    first = before & ~apart
    after = np.append(apart[1:], True)
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(after & ~apart) + 1
    doc = np.searchsorted(off, starts, "right") - 1
    piece = np.cumsum(_BREAK[buf], dtype=np.int32)[starts] + doc
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), doc, piece
    at = np.cumsum(first, dtype=np.int32)
    at -= 1
    np.maximum(at, 0, out=at)
    within = np.arange(len(buf), dtype=np.int32)
    within -= starts.astype(np.int32)[at]
    within &= 4095
    value = _BYTES_LOWER[buf]
    value[apart] = 0
    value *= _POWERS[within]
    return starts, ends, mix(np.add.reduceat(value, starts)), doc, piece


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of stretches."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Words:
    """The words of documents of a block: bytes, hash, piece and language of each."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: np.ndarray) -> None:
        self.buf = _LOWER[buf]
        parts, pieces = [[np.zeros(0, np.int64)] for _ in range(5)], 0
        parts[2] = [np.zeros(0, np.uint64)]
        for i, j in slices(off):
            if off[j] == off[i]:
                continue
            starts, ends, h, doc, piece = split(self.buf[off[i] : off[j]], off[i : j + 1] - off[i])
            for into, x in zip(parts, (starts + off[i], ends + off[i], h, langs[doc + i], piece + pieces), strict=True):
                into.append(x)
            pieces += int(off[j] - off[i]) + j - i + 1  # more than the slice has
        self.starts, self.ends, self.hash, self.lang, self.piece = (np.concatenate(x) for x in parts)

    def numbers(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word in a list of different words, the list); hashes propose, bytes decide."""
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        size = self.ends - self.starts
        like = first[number]
        bad = size != size[like]
        for i in range(0, len(size), 1 << 17):
            ok = i + np.flatnonzero(~bad[i : i + (1 << 17)])
            at = spread(self.starts[ok], size[ok])
            other = np.flatnonzero(self.buf[at] != self.buf[spread(self.starts[like[ok]], size[ok])])
            bad[ok[np.searchsorted(np.cumsum(size[ok]), other, "right")]] = True
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(bad).tolist():
            number[i] = more.setdefault(self.buf[self.starts[i] : self.ends[i]].tobytes(), len(first) + len(more))
        n = size[first]
        ends = np.append(0, np.cumsum(n)).astype(np.int64)
        listed = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.buf[spread(self.starts[first], n)])))
        return number, pa.concat_arrays([listed, pa.array([k.decode() for k in more], pa.large_string())]) if more else listed


def fingerprints(w: Words, salts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, number of words, first word) of all n-grams within pieces, by number of words and place."""
    n = len(w.hash)
    up, down = powers(BASE, n), powers(_UNBASE, n)
    prefix = np.append(np.uint64(0), np.cumsum(w.hash * up, dtype=np.uint64))
    keys, sizes, firsts = [], [], []
    for k in range(1, longest + 1):
        i = np.flatnonzero(w.piece[: n - k + 1] == w.piece[k - 1 :]) if n >= k else np.zeros(0, np.int64)
        keys.append(mix(((prefix[i + k] - prefix[i]) * down[i] + np.uint64(k)) ^ salts[w.lang[i]]))
        sizes.append(np.full(len(i), k, np.int8))
        firsts.append(i)
    return np.concatenate(keys), np.concatenate(sizes), np.concatenate(firsts)


def _salts(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


class Table:
    """The n-grams of a block by fingerprint."""

    def __init__(self, texts: np.ndarray, off: np.ndarray, langs: list[str], longest: int) -> None:
        self.names = sorted(set(langs))
        of = {x: i for i, x in enumerate(self.names)}
        self.words = Words(texts, off, np.array([of[x] for x in langs], np.int64))
        keys, self.sizes, self.firsts = fingerprints(self.words, _salts(self.names), longest)
        by = np.argsort(keys, kind="stable")
        s = keys[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        self.keys, self.counts, self.pointer = s[at], np.diff(np.append(at, len(s))), by[at]
        self.number = np.empty(len(s), np.int32)
        self.number[by] = np.cumsum(new) - 1

    def phrases(self, frequent: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """(language, phrase, occurrences) of the n-grams whose fingerprint is frequent; occurrences are compared with the one that the pointer names."""
        number, listed = self.words.numbers()
        gram = np.flatnonzero(frequent[self.number])
        to = self.pointer[self.number[gram]]
        a, b, n = self.firsts[gram], self.firsts[to], self.sizes[gram]
        same = (n == self.sizes[to]) & (self.words.lang[a] == self.words.lang[b])
        for k in range(int(n.max()) if len(n) else 0):
            more = np.flatnonzero(same & (n > k))
            same[more] = number[a[more] + k] == number[b[more] + k]
        counts = np.bincount(self.number[gram[same]], minlength=len(self.keys))
        each = np.flatnonzero(counts)
        # An n-gram with the fingerprint of another stands for itself.
        for grams, times in ((self.pointer[each], counts[each]), (gram[~same], np.ones(int((~same).sum()), np.int64))):
            for k in np.unique(self.sizes[grams]).tolist():
                pick = self.sizes[grams] == k
                first = self.firsts[grams[pick]]
                parts = [listed.take(pa.array(number[first + j])) for j in range(k)]
                yield pa.array(self.names).take(pa.array(self.words.lang[first])), pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()), times[pick]

    def totals(self) -> np.ndarray:
        return np.bincount(self.words.lang, minlength=len(self.names))


def _blocks(it: Iterator[pa.RecordBatch], homes: int, stride: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """(number, bytes, offsets, languages) of blocks; a number begins with the block's home, and the blocks of a partition go to homes next to each other."""
    context = TaskContext.get()
    part, seq, size, held = context.partitionId() if context else 0, 0, 0, []

    def block():
        texts = np.concatenate([x for x, _, _ in held])
        off = np.append(0, np.cumsum(np.concatenate([np.diff(o) for _, o, _ in held])))
        low = int(mix(np.array([part << 24 | seq], np.uint64))[0])
        return (part * stride + seq) % homes << HOME_SHIFT | low & (1 << HOME_SHIFT) - 1, texts, off, [x for _, _, names in held for x in names]

    for rows, buf, off in batches(it, "text"):
        held.append((buf.copy(), off, rows.column("lang").to_pylist()))
        size += len(buf)
        if size >= BLOCK_BYTES:
            yield block()
            held, size, seq = [], 0, seq + 1
    if held:
        yield block()


def _ask(it: Iterator[pa.RecordBatch], longest: int, bits: int, homes: int, stride: int) -> Iterator[pa.RecordBatch]:
    for number, texts, off, langs in _blocks(it, homes, stride):
        t = Table(texts, off, langs, longest)
        if not len(t.keys):
            continue
        rest = 64 - bits
        bucket = (t.keys >> np.uint64(rest)).astype(np.int32)
        low = t.keys & np.uint64((1 << rest) - 1)
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(low))
        starts = np.append(0, ends[:-1])
        step = np.diff(low, prepend=np.uint64(0))
        step[starts] = low[starts]
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        keys = [pack(step[i:j], max(0, (rest - (j - i).bit_length()) // 8)) for i, j in spans]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(ends), number), pa.int64()), pa.array(keys, pa.binary()), pa.array([pack(t.counts[i:j]) for i, j in spans], pa.binary())], ["bucket", "block", "keys", "counts"])


def _answer(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """For each block of a bucket one bit for each of its fingerprints: whether all blocks together hold it ``least`` times."""

    def joined(rows: list[dict]) -> pa.RecordBatch:
        keys = [np.cumsum(unpack(r["keys"]), dtype=np.uint64) for r in rows]
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        s = every[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        sums = np.add.reduceat(np.concatenate([unpack(r["counts"]) for r in rows])[by], np.flatnonzero(new))
        out = np.empty(len(s), bool)
        out[by] = (sums >= least)[np.cumsum(new) - 1]
        parts = np.split(out, np.cumsum([len(k) for k in keys])[:-1])
        bits = [len(p).to_bytes(4, "little") + np.packbits(p).tobytes() for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int64()), pa.array(bits, pa.binary())], ["bucket", "block", "bits"])

    held: list[dict] = []
    for batch in it:
        for r in batch.to_pylist():
            if held and r["bucket"] != held[0]["bucket"]:
                yield joined(held)
                held = []
            held.append(r)
    if held:
        yield joined(held)


def _texts(it: Iterator[pa.RecordBatch], homes: int, stride: int) -> Iterator[pa.RecordBatch]:
    for number, texts, off, langs in _blocks(it, homes, stride):
        sizes = _CODEC.compress(np.diff(off).astype("<i8").tobytes(), asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(langs)], pa.int64()), pa.array([sizes], pa.binary()), pa.array([_CODEC.compress(texts.tobytes(), asbytes=True)], pa.binary()), pa.array([langs], pa.list_(pa.string()))], ["block", "n", "sizes", "texts", "langs"])


def _phrases(it: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its texts first, then the answers by bucket. A row without a phrase holds a language's words."""

    def counted(block: dict, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        off = np.append(0, np.cumsum(np.frombuffer(_CODEC.decompress(block["sizes"], 8 * block["n"], asbytes=True), np.int64)))
        t = Table(np.frombuffer(_CODEC.decompress(block["texts"], int(off[-1]), asbytes=True), np.uint8), off, block["langs"], longest)
        bits = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")) for x in answers]
        frequent = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        if len(frequent) != len(t.keys):
            raise RuntimeError("answers don't match a block: the input was read in another order the second time")
        names = ["lang", "phrase", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(t.names, pa.string()), pa.nulls(len(t.names), pa.string()), pa.array(t.totals(), pa.int64())], names)
        for lang, phrase, n in t.phrases(frequent):
            for i in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([lang.slice(i, 50_000).cast(pa.string()), phrase.slice(i, 50_000), pa.array(n[i : i + 50_000], pa.int64())], names)

    block, answers = None, []
    for batch in it:
        for i in range(batch.num_rows):  # one by one: rows hold whole blocks
            r = batch.slice(i, 1).to_pylist()[0]
            if block is not None and r["block"] != block["block"]:
                yield from counted(block, answers)
                block, answers = None, []
                release()
            if r["texts"] is not None:
                block = r
            elif block is None:
                raise RuntimeError("an answer without its block: the input was read in another order the second time")
            else:
                answers.append(r["bits"])
    if block is not None:
        yield from counted(block, answers)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n: exact occurrences of all phrases of up to ``longest`` words that occur ``least`` times or more, and in rows of null phrase the words of each language."""
    rows, own = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")), None
    if not _only_reads(rows):
        rows = own = materialise(rows, "documents")
    size = max(8, input_bytes(docs) // BUCKET_BYTES)
    bits = min(30, (size - 1).bit_length())
    parts = min(1 << bits, 20_000)  # partitions only: a task takes one bucket after the other
    homes = int(min(20_000, max(8, size // 4)))  # partitions only: a task takes one block after the other and sums their phrases first
    stride = -(-homes // max(1, rows._jdf.queryExecution().toRdd().getNumPartitions()))
    asked = rows.mapInArrow(lambda it: _ask(it, longest, bits, homes, stride), "bucket int, block long, keys binary, counts binary")
    answers = asked.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(lambda it: _answer(it, least), "bucket int, block long, bits binary")
    texts = rows.mapInArrow(lambda it: _texts(it, homes, stride), "block long, n long, sizes binary, texts binary, langs array<string>")
    both = texts.unionByName(answers, allowMissingColumns=True)
    both = both.repartitionById(homes, F.shiftrightunsigned("block", HOME_SHIFT).cast("int")).sortWithinPartitions("block", F.col("bucket").asc_nulls_first())
    each = both.mapInArrow(lambda it: _phrases(it, longest), "lang string, phrase string, n long")
    out = materialise(each.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")
    if own is not None:
        forget(own)
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = WITHIN) -> DataFrame:
    """lang, rank (from 1), phrase, a (its occurrences), l and r (those of the parts of its weakest cut), n (the language's words), score (millionths, rounded down).

    Rank is by score and a descending, then by the bytes of the phrase. The weakest cut is the one of least score, of equal ones the first.
    """
    counts = phrase_counts(docs, least, longest)
    totals = counts.where("phrase is null").select(F.col("lang").alias("t_lang"), F.col("n"))
    some = counts.where("phrase is not null").select("lang", "phrase", F.col("n").alias("a"))
    longer = some.withColumn("ws", F.split("phrase", " ")).where(F.size("ws") > 1)
    part = lambda i, n: F.array_join(F.slice("ws", i, n), " ")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    left = some.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = some.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    parted = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    parted = parted.withColumns({"over": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    scored = parted.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Occurrences fall with length, so what a phrase of one word more doesn't reach no longer one does.
    inner = longer.where(F.size("ws") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("ws") - 1), part(F.lit(2), F.size("ws") - 1))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    found = scored.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < within * F.col("a")))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for salts in (256, 16):  # the best of parts first, so that no task ranks all phrases of a language
        up = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
