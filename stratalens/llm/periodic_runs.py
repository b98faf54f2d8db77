"""Runs of periodic words inside documents (operator 12), by descending-LCP Kruskal.

A run is a stretch of consecutive words of smallest period q (words q apart are the same) and of at
least max(``least``, 2 q) words that no neighbouring word extends. For each document:

1. Only documents in which a sequence of ``least`` / 2 words stands twice can hold a run; the rest is done.
2. The suffixes are sorted by prefix doubling. Neighbours in that order get their longest common prefix
   (LCP) by descending through the ranks that the doubling left.
3. The neighbours are united in order of falling LCP, smaller class into larger. A class is an ordered
   set of positions. Two positions i < j from different classes that become neighbours of each other
   share exactly LCP words; where j - i <= LCP, the words from i on repeat with period j - i for
   j - i + LCP words, and no word to the right extends them. The period is the smallest one: with a
   smaller one another position of the class would lie between i and j.
4. Of these seeds the ones that no word to the left extends are the runs, each found once.

A document is the unit of work: a task reads its partition batch by batch, nothing is shuffled or
collected, and memory grows with the words of the longest text (some 4 bytes a word for each doubling).
Sets of more than ``BLOCK`` positions are kept in blocks, so a text that repeats one word a million
times costs no quadratic moves. Words are told apart by 64 bits of hash within a document.

Words are maximal runs of bytes other than ASCII white space. Null and empty texts have no words and no
run, and collapse to the empty text. Rows are independent: repeated rows, shared and null ids get a
result each. Other columns don't matter and may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import _SPACE, WORD, batches, doc_rows, mix, words

#: Least number of words of a run; positions of a block of a large ordered set.
LEAST, BLOCK = 12, 2048

_GRAM = np.random.default_rng(0x12).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Ordered:
    """A large ordered set of positions in blocks: adding one moves no more than a block."""

    def __init__(self, xs: list[int]) -> None:
        self.blocks = [xs[i : i + BLOCK] for i in range(0, len(xs), BLOCK)]
        self.firsts = [b[0] for b in self.blocks]
        self.n = len(xs)

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.firsts, x) - 1)
        b = self.blocks[k]
        insort(b, x)
        self.firsts[k] = b[0]
        self.n += 1
        if len(b) > 2 * BLOCK:
            self.blocks[k : k + 1] = [b[:BLOCK], b[BLOCK:]]
            self.firsts[k : k + 1] = [b[0], b[BLOCK]]

    def around(self, x: int) -> tuple[int, int]:
        """Neighbours of a member, -1 where there is none."""
        k = bisect_right(self.firsts, x) - 1
        b = self.blocks[k]
        i = bisect_left(b, x)
        before = b[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        after = b[i + 1] if i + 1 < len(b) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return before, after


def sorted_suffixes(doc: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their suffixes within each document, LCP of each with the one before it, 0 at a document's first).

    ``doc`` and ``end`` give each word's document and where that ends; ``h`` the words.
    """
    n = len(h)
    at = np.arange(n)
    by = np.lexsort((h, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (h[by][1:] != h[by][:-1])
    first = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int64)
    rank[by] = first
    suffixes, level = by, np.full(n, -1, np.int8)
    level[new & (np.append(False, doc[by][1:] == doc[by][:-1]) if n else new)] = 0
    ranks, m, k = [rank.astype(np.int32)], 1, 0
    alone = new & np.append(new[1:], True) if n else new
    slots = np.flatnonzero(~alone)
    while len(slots):
        where = suffixes[slots]
        ahead = where + m
        inside = ahead < end[where]
        key = rank[where] << 32
        key[inside] += rank[ahead[inside]] + 1
        order = np.argsort(key, kind="stable")
        where, key = where[order], key[order]
        suffixes[slots] = where
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        same_before = np.append(False, key[1:] >> 32 == key[:-1] >> 32)
        k, m = k + 1, 2 * m
        level[slots[new & same_before]] = k
        rank[where] = np.maximum.accumulate(np.where(new, slots, 0))
        ranks.append(rank.astype(np.int32))
        slots = slots[~(new & np.append(new[1:], True))]
    # Neighbours that came apart at level k share 2^(k-1) words and fewer than 2^k.
    lcp = np.zeros(n, np.int64)
    for k in range(1, len(ranks)):
        s = np.flatnonzero(level == k)
        a, b, shared = suffixes[s - 1], suffixes[s], np.full(len(s), 1 << (k - 1))
        for j in range(k - 2, -1, -1):
            x, y = a + shared, b + shared
            same = (x < end[a]) & (y < end[b])
            same[same] = ranks[j][x[same]] == ranks[j][y[same]]
            shared[same] += 1 << j
        lcp[s] = shared
    return suffixes, lcp


def seeds(suffixes: np.ndarray, lcp: np.ndarray, least_lcp: int) -> list[tuple[int, int, int]]:
    """(i, j, LCP) of positions from two classes that become neighbours when these are united, with j - i <= LCP; classes are united by falling LCP."""
    slots = np.flatnonzero(lcp >= least_lcp)
    slots = slots[np.argsort(-lcp[slots], kind="stable")]
    found: list[tuple[int, int, int]] = []
    parent: dict[int, int] = {}
    members: dict[int, list[int] | Ordered] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for slot, share, a, b in zip(slots.tolist(), lcp[slots].tolist(), suffixes[slots - 1].tolist(), suffixes[slots].tolist(), strict=True):
        left, right = root(slot - 1), root(slot)
        big, small = members.pop(left, None) or [a], members.pop(right, None) or [b]
        if len(big) < len(small):
            big, small, left, right = small, big, right, left
        parent[right] = left
        if len(big) > 2 * BLOCK and isinstance(big, list):
            big = Ordered(big)
        some = list(small)
        if isinstance(big, list):
            for x in some:
                insort(big, x)
        else:
            for x in some:
                big.add(x)
        last = len(some) - 1
        for i, x in enumerate(some):
            if isinstance(big, list):
                at = bisect_left(big, x)
                before, after = big[at - 1] if at else -1, big[at + 1] if at + 1 < len(big) else -1
            else:
                before, after = big.around(x)
            if before >= 0 and x - before <= share and not (i and some[i - 1] == before):
                found.append((before, x, share))
            if after >= 0 and after - x <= share and not (i < last and some[i + 1] == after):
                found.append((x, after, share))
        members[left] = big
    return found


def find_runs(h: np.ndarray, woff: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start within it, length, period) of all runs, by document, start and period."""
    none = np.zeros((0, 4), np.int64)
    half = max(1, (least + 1) // 2)
    lengths = np.diff(woff)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(woff[1:], lengths)
    at = np.arange(len(h))
    whole = at + half <= end
    acc = np.zeros(len(h), np.uint64)
    for j in range(min(half, len(h))):
        acc[: len(h) - j] += h[j:] * _GRAM[j]
    keys = mix(acc[whole] ^ mix(doc[whole].astype(np.uint64)))
    keys = np.sort(keys << np.uint64(20) | (doc[whole] & 0xFFFFF).astype(np.uint64))
    twice = np.unique((keys[1:][keys[1:] == keys[:-1]] & np.uint64(0xFFFFF)).astype(np.int64))
    if not len(twice):
        return none
    pick = np.isin(doc & 0xFFFFF, twice)
    sub = at[pick]
    if not len(sub):
        return none
    n_sub = np.bincount(doc[pick], minlength=len(lengths))
    sub_end = np.repeat(np.cumsum(n_sub), n_sub)
    some = h[pick]
    suffixes, lcp = sorted_suffixes(doc[pick], sub_end, some)
    got = np.array(seeds(suffixes, lcp, half), np.int64).reshape(-1, 3)
    i, j, share = got.T
    period = j - i
    base = (sub_end - np.repeat(n_sub, n_sub))[i]
    open_left = i > base
    open_left[open_left] = some[i[open_left] - 1] == some[j[open_left] - 1]
    ok = ~open_left & (period + share >= least)
    out = np.stack([doc[pick][i], i - base, period + share, period], axis=1)[ok]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _rows(it: Iterator[pa.RecordBatch], least: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in batches(it, "text"):
        h, woff = words(buf, off)
        found = find_runs(h, woff, least)
        n_docs = len(off) - 1
        # A word is dropped if a run holds it after that run's first period.
        step = np.zeros(len(h) + 1, np.int64)
        begin = woff[found[:, 0]] + found[:, 1]
        np.add.at(step, begin + found[:, 3], 1)
        np.add.at(step, begin + found[:, 2], -1)
        kept = np.cumsum(step[:-1]) == 0
        space = _SPACE[buf]
        before = np.append(True, space[:-1]) if len(buf) else np.zeros(0, bool)
        before[off[:-1][off[:-1] < len(buf)]] = True
        first = before & ~space
        word = np.maximum(np.cumsum(first) - 1, 0)
        take = np.flatnonzero(~space & kept[word]) if len(h) else np.zeros(0, np.int64)
        seq = np.cumsum(kept) - 1
        out = np.full(len(take) + int(kept.sum()), 32, np.uint8)
        out[np.arange(len(take)) + (seq[word[take]] if len(take) else 0)] = buf[take]
        doc_of_byte = np.searchsorted(off, take, "right") - 1
        n_kept = np.add.reduceat(np.append(kept, False), np.minimum(woff[:-1], len(h))) * (np.diff(woff) > 0) if n_docs else np.zeros(0, np.int64)
        size = np.bincount(doc_of_byte, minlength=n_docs) + n_kept
        ends = np.cumsum(size)
        texts = [out[e - s : e - 1].tobytes().decode() if s else "" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        runs_off = np.searchsorted(found[:, 0], np.arange(n_docs + 1))
        parts = [pa.array(found[:, c], pa.int64()) for c in (1, 2, 3)]
        runs = pa.ListArray.from_arrays(pa.array(runs_off.astype(np.int32)), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(np.diff(woff)), runs, pa.array(texts, pa.string())], [*keep, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and the text without the repeats (kept words joined by one space) of each document."""
    if least < 2:
        raise ValueError("a run has two words at least")
    return doc_rows(docs).mapInArrow(lambda it: _rows(it, least, ("doc_id",)), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(runs: DataFrame) -> DataFrame:
    """Numbers and digests of what ``periodic_runs`` gives; the longest run, of equal ones the first, of these the one of least period."""
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))))
    top = F.get(best, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return runs.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.col("top.b").alias("start"),
        (-F.col("top.a")).alias("length"),
        F.col("top.c").alias("period"),
        F.expr("-1000 * top.a div top.c").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def with_periods(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic: with h = ``key`` (crc32 of the id), g = h div 10, n words and h a multiple of 10,
    each word i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) if key is None else key
    rows = doc_rows(docs).withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("ws", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))).withColumn("n", F.size("ws"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    made = F.expr("array_join(concat(slice(ws, 1, a), slice(flatten(array_repeat(slice(ws, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
