"""Substring dedup by recompression (operator 6).

A text's words are parsed in rounds. The first round names maximal runs of one word, each later
round names pairs: a symbol's own name decides, by a hash bit of the round, whether it can stand
left or right in a pair, and a left one joins a right one behind it. Names are 64-bit fingerprints of
what they stand for, so all tasks give equal strings the same names without talking to each other.
Inside two equal strings the rounds make the same symbols but for one at either end of each round,
which may reach outside. What is certain to be inside a window of ``WINDOW`` words is therefore a
function of its words alone, and so is its *core*: of the certain symbols of the highest level (of
``LEVELS``) that has any, the longest class's least hashed name. Equal windows share their core, and a
core serves about six neighbouring windows.

So windows meet by core: each block of texts sends a core once with the fingerprints of the windows
that it serves (40 bits, besides the 64 of the core), packed for each bucket of core names. In a
bucket all but the first window of equal ones, by (document, start), are marked. A block first marks
those that start earlier in the block itself and sends the others only. A task remembers windows that
it met in blocks on end (``KNOWN`` of them at most) and marks later ones itself, so a passage that
stands in very many documents reaches its bucket a few times for each task. Marked windows go back to their
documents, packed for each *home* (a bucket of doc_ids; of texts where the id is null), and the covered
words are removed. A core that serves more windows than a task may hold (``HELD_BYTES``) has its windows
dealt anew by bits of their own hashes, again and again if need be, so no task holds a share of all windows.

Order of documents: doc_id (null first), then a 64-bit hash of the text; rows that agree in both are one
document and have the same result. Null and empty texts have no words and nothing to remove; texts
under ``WINDOW`` words lose nothing. Marks rest on 104 bits of fingerprint: the chance of one wrong
mark in 10^10 windows is below 10^-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import batches, doc_rows, freed, input_bytes, materialise, mix, shingles, slices, spark_xxhash64, text_column, words

WINDOW = 20
#: Bytes of text that are parsed together, and of stored input that meet in a bucket and in a home.
BLOCK_BYTES, BUCKET_BYTES, HOME_BYTES = 4 << 20, 4 << 20, 8 << 20
#: Words of whole texts that are parsed together: what parsing needs on the way is some 150 bytes a word.
PARSED_WORDS = 1 << 16
#: Levels of symbols: words, then after naming runs, then after each of three rounds of pairs.
LEVELS = 5
NULL_ID = -(1 << 63)
#: Windows that a task remembers; others are sent, so the number doesn't change results.
KNOWN = 400_000
#: Bytes of a bucket that a task holds; a larger one is split by the windows' own hashes, so many bits at a time.
HELD_BYTES, SPLIT_BITS = 48 << 20, 12

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _salt(level: int, by: np.uint64) -> np.uint64:
    return np.uint64(level * int(by) & (1 << 64) - 1)


def name_runs(sym: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, where each new symbol starts) after naming maximal runs of equal symbols within documents."""
    first = np.ones(len(sym), bool)
    first[1:] = sym[1:] != sym[:-1]
    first |= doc_start
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(sym)))
    names = sym[at]
    long = n > 1
    names[long] = mix(names[long] * _A + n[long].astype(np.uint64) * _C + np.uint64(1))
    return names, at


def coins(sym: np.ndarray, level: int) -> np.ndarray:
    """True where a symbol can only stand on the right of a pair."""
    return (mix(sym + _salt(level, _C)) >> np.uint64(63)).astype(bool)


def name_pairs(sym: np.ndarray, doc_start: np.ndarray, right: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, where each new symbol starts) after naming every pair of a left and a right symbol."""
    joined = np.zeros(len(sym), bool)
    joined[1:] = right[1:] & ~right[:-1] & ~doc_start[1:]
    at = np.flatnonzero(~joined)
    names = sym[at]
    pair = np.zeros(len(sym) + 1, bool)
    pair[:-1] = joined
    two = pair[at + 1]
    names[two] = mix(sym[at[two]] * _A + sym[at[two] + 1] * _B + np.uint64(level))
    return names, at


def cores(h: np.ndarray, woff: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows with one core each: (first window, window behind the last, core name, core's first word).

    Every text has at least ``window`` words; windows count through all texts, text by text.
    """
    nw = np.diff(woff)
    n_windows = nw - window + 1
    s = np.arange(int(n_windows.sum()))
    lo = s + np.repeat(np.arange(len(nw)) * (window - 1), n_windows)
    hi = lo + window
    e = s + 1
    sym, begin = h, np.arange(len(h))
    doc_start = np.zeros(len(h), bool)
    doc_start[woff[:-1]] = True
    out = []
    for level in range(LEVELS):
        if level == 0:
            names, at = name_runs(sym, doc_start)
            parent = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(sym))))
            lo2, hi2 = parent[lo] + 1, parent[hi - 1]
        else:
            right = coins(sym, level)
            names, at = name_pairs(sym, doc_start, right, level)
            parent = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(sym))))
            lo2, hi2 = parent[lo] + right[lo], parent[hi - 1] + right[hi - 1]
        gone = lo2 >= hi2
        if level == LEVELS - 1:
            gone[:] = True
        if gone.any():
            out.append(_least(s[gone], e[gone], lo[gone], hi[gone], sym, begin, len(h), level))
            stay = ~gone
            s, e, lo2, hi2 = s[stay], e[stay], lo2[stay], hi2[stay]
        if not len(s):
            break
        new = np.ones(len(s), bool)
        new[1:] = (lo2[1:] != lo2[:-1]) | (hi2[1:] != hi2[:-1])
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(s)) - 1
        s, e, lo, hi = s[firsts], e[lasts], lo2[firsts], hi2[firsts]
        sym, begin, doc_start = names, begin[at], doc_start[at]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    s, e, name, word = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(s, kind="stable")
    s, e, name, word = s[order], e[order], name[order], word[order]
    new = np.ones(len(s), bool)
    new[1:] = (name[1:] != name[:-1]) | (word[1:] != word[:-1])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(s)) - 1
    return s[firsts], e[lasts], name[firsts], word[firsts]


def _least(s, e, lo, hi, sym, begin, n_words, level):
    """The core of each range of windows whose certain symbols at this level are lo to hi: of those of three words or more, else two, else one, the least hashed name, the leftmost of equal ones.

    Short symbols are common words; passing over them keeps the groups that meet small.
    """
    length = np.diff(np.append(begin, n_words))
    order = mix(sym ^ _B) >> np.uint64(2) | (np.uint64(3) - np.minimum(length, 3).astype(np.uint64)) << np.uint64(62)
    best, at = order[lo], lo.copy()
    for j in range(1, int((hi - lo).max(initial=1))):
        k = np.flatnonzero(hi - lo > j)
        x = order[lo[k] + j]
        better = x < best[k]
        best[k[better]] = x[better]
        at[k[better]] = lo[k[better]] + j
    return s, e, mix(sym[at] + _salt(level, _A)), begin[at]


def _chunks(woff: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PARSED_WORDS`` words; a longer text is a range of its own."""
    return slices(woff, PARSED_WORDS)


def parsed(h: np.ndarray, woff: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every window, number of windows of each core's range, the core's name), a few texts at a time."""
    hashes = np.empty(int((np.diff(woff) - window + 1).sum()), np.uint64)
    at, sizes, names = 0, [], []
    for i, j in _chunks(woff):
        part, off = h[woff[i] : woff[j]], woff[i : j + 1] - woff[i]
        own, _ = shingles(part, off, window)
        hashes[at : at + len(own)] = own
        at += len(own)
        s, e, name, _ = cores(part, off, window)
        sizes.append((e - s).astype(np.int32))
        names.append(name)
    return hashes, np.concatenate(sizes), np.concatenate(names)


def marked_words(starts: np.ndarray, counts: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words are covered by windows whose starts are given as runs (start, how many)."""
    delta = np.zeros(n_words + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + counts + window - 1, -1)
    return np.cumsum(delta[:-1]) > 0


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values cut from an array at row numbers."""
    size = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    off = np.concatenate([[0], ends * size]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


COLUMNS = ("bucket", "home", "docs", "ths", "runs_of", "runs", "cores_of", "names", "starts", "counts", "hashes")
SCHEMA = "bucket int, home int, " + ", ".join(f"{c} binary" for c in COLUMNS[2:])
MARKS = ["home", "docs", "ths", "runs_of", "runs"]


def _cut(key: np.ndarray) -> np.ndarray:
    """Ends of the stretches of equal keys."""
    last = np.ones(len(key), bool)
    last[:-1] = key[1:] != key[:-1]
    return np.flatnonzero(last) + 1


def _marks(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, ths: np.ndarray, homes: int) -> list[pa.Array]:
    """Marked windows, given as (document number, window start) in order, as one row for each home: its documents and their runs (first start, number of windows)."""
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    new = new_doc.copy()
    new[1:] |= pos[1:] != pos[:-1] + 1
    at = np.flatnonzero(new)
    runs = np.stack([pos[at], np.diff(np.append(at, len(doc)))], axis=1).astype(np.uint32)
    who = ids[doc[at]]
    home = spark_xxhash64(np.where(who == NULL_ID, ths[doc[at]], who)) % homes
    by = np.argsort(home, kind="stable")
    runs, home, d = runs[by], home[by], doc[at][by]
    each = _cut(d)
    d, per = d[each - 1], np.diff(np.concatenate([[0], each])).astype(np.uint32)
    ends = _cut(home[each - 1])
    return [pa.array(home[each - 1][ends - 1].astype(np.int32)), _binary(ids[d], ends), _binary(ths[d], ends), _binary(per, ends), _binary(runs, each[ends - 1])]


class Known:
    """Windows met in consecutive blocks of a task, each with the earliest place (doc_id, text hash, start) sent so far."""

    def __init__(self) -> None:
        self.last = np.zeros(0, np.uint64)
        self.hash, self.id, self.th, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, hashes: np.ndarray, ids: np.ndarray, ths: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which windows start behind a known equal one; what is met in this block and the last one becomes known."""
        late = np.zeros(len(hashes), bool)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            k = np.flatnonzero(self.hash[at] == hashes)
            a = at[k]
            i, t, s = ids[k], ths[k], starts[k]
            before = (self.id[a] < i) | (self.id[a] == i) & ((self.th[a] < t) | (self.th[a] == t) & (self.start[a] < s))
            late[k[before]] = True
            k, a = k[~before], a[~before]
            self.id[a], self.th[a], self.start[a] = ids[k], ths[k], starts[k]
        sent = np.flatnonzero(~late)
        now = np.sort(hashes[sent])
        if len(self.last) and len(now):
            again = now[np.minimum(np.searchsorted(now, self.last), len(now) - 1)] == self.last
            new = np.setdiff1d(self.last[again], self.hash)
            if len(new):
                if len(self.hash) + len(new) > KNOWN:
                    self.hash, self.id, self.th, self.start = (x[:0] for x in (self.hash, self.id, self.th, self.start))
                    new = new[:KNOWN]
                by = sent[np.argsort(hashes[sent], kind="stable")]
                k = by[np.searchsorted(hashes[by], new)]
                order = np.argsort(np.concatenate([self.hash, new]), kind="stable")
                self.hash, self.id, self.th, self.start = (np.concatenate([x, y])[order] for x, y in ((self.hash, new), (self.id, ids[k]), (self.th, ths[k]), (self.start, starts[k])))
        self.last = now
        return late


def _block(ids: np.ndarray, ths: np.ndarray, h: np.ndarray, woff: np.ndarray, n_buckets: int, homes: int, window: int, known: Known) -> Iterator[pa.RecordBatch]:
    """What one block of texts sends: marks of its own, and cores for each bucket."""
    nw = np.diff(woff)
    order = np.lexsort((ths, ids))
    order = order[nw[order] >= window]
    if len(order) > 1:  # rows that agree in id and text are one document
        same = np.zeros(len(order), bool)
        same[1:] = (ids[order][1:] == ids[order][:-1]) & (ths[order][1:] == ths[order][:-1])
        order = order[~same]
    if not len(order):
        return
    h = np.concatenate([h[woff[i] : woff[i + 1]] for i in order.tolist()])
    ids, ths = ids[order], ths[order]
    woff = np.concatenate([[0], np.cumsum(nw[order])])
    per_doc = np.diff(woff) - window + 1
    n = int(per_doc.sum())
    hashes, size, name = parsed(h, woff, window)
    del h
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), per_doc)
    pos = np.arange(n, dtype=np.int32) - np.repeat(np.concatenate([[0], np.cumsum(per_doc)[:-1]]).astype(np.int32), per_doc)
    by = np.argsort(hashes, kind="stable").astype(np.int32)
    later = np.zeros(n, bool)
    later[by[1:]] = hashes[by[1:]] == hashes[by[:-1]]
    del by
    first = np.flatnonzero(~later).astype(np.int32)
    later[first] = known.later(hashes[first], ids[doc[first]], ths[doc[first]].astype(np.int64), pos[first])
    del first
    if later.any():
        k = np.flatnonzero(later)
        found = _marks(doc[k], pos[k], ids, ths, homes)
        m = len(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(found[0]) % n_buckets, pa.int32()), *found, *[pa.nulls(m, pa.binary())] * 5], list(COLUMNS))
    core = np.repeat(np.arange(len(size), dtype=np.int32), size)
    new = np.ones(n, bool)
    new[1:] = (core[1:] != core[:-1]) | (later[1:] != later[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    at, count = at[~later[at]], count[~later[at]]
    name = name[core[at]]
    bucket = (name % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    at, count, name, bucket = at[by], count[by], name[by], bucket[by]
    if not len(at):
        return
    win = np.repeat(at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    five = (hashes[win] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
    ends = _cut(bucket)
    new_doc = np.zeros(len(at), bool)
    new_doc[np.append(0, ends[:-1])] = True
    new_doc[1:] |= doc[at[1:]] != doc[at[:-1]]
    d_at = np.flatnonzero(new_doc)
    d_n = np.diff(np.append(d_at, len(at))).astype(np.uint32)
    d_ends = np.searchsorted(d_at, ends)
    w_ends = np.cumsum(count)[ends - 1]
    d = doc[at[d_at]]
    m = len(ends)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[ends - 1].astype(np.int32)),
            pa.nulls(m, pa.int32()),
            _binary(ids[d], d_ends),
            _binary(ths[d], d_ends),
            pa.nulls(m, pa.binary()),
            pa.nulls(m, pa.binary()),
            _binary(d_n, d_ends),
            _binary(name, ends),
            _binary(pos[at].astype(np.uint32), ends),
            _binary(count.astype(np.uint8), ends),
            _binary(five, w_ends),
        ],
        list(COLUMNS),
    )


def _send(it: Iterator[pa.RecordBatch], n_buckets: int, homes: int, window: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    known = Known()

    def flush():
        ids, ths, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return _block(ids, ths, h, np.concatenate([[0], np.cumsum(n)]), n_buckets, homes, window, known)

    for rows, buf, off in batches(it, "text"):
        h, woff = words(buf, off)
        held.append((np.asarray(rows.column("doc_id").fill_null(NULL_ID)), np.asarray(rows.column("th")), h, np.diff(woff)))
        size += len(buf)
        if size >= BLOCK_BYTES:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def _windows(blobs: list[dict]) -> tuple[np.ndarray, ...]:
    """(doc_ids, text hashes, and of each window its document, start, core's name, 40 bits of hash and key) of rows of a bucket, by place."""
    whole = lambda c, kind: np.concatenate([np.frombuffer(b[c], kind) for b in blobs])
    per_doc = whole("cores_of", np.uint32)
    ids, ths = whole("docs", np.int64), whole("ths", np.int64)
    doc = np.repeat(np.arange(len(ids)), per_doc)
    name, start, count = whole("names", np.uint64), whole("starts", np.uint32).astype(np.int64), whole("counts", np.uint8).astype(np.int64)
    five = whole("hashes", np.uint8).reshape(-1, 5)
    h40 = np.zeros((len(five), 8), np.uint8)
    h40[:, :5] = five
    h40 = h40.view(np.uint64)[:, 0]
    order = np.lexsort((start, ths[doc], ids[doc]))
    w0 = np.concatenate([[0], np.cumsum(count)[:-1]])[order]
    doc, name, start, count = doc[order], name[order], start[order], count[order]
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    h40 = h40[w0[row] + inside]
    return ids, ths, doc[row], start[row] + inside, name[row], h40, mix(name[row] ^ (h40 * _A))


def _mark(blobs: list[dict], homes: int) -> pa.RecordBatch | None:
    """Marked windows of one bucket."""
    ids, ths, doc, pos, name, h40, key = _windows(blobs)
    by = np.argsort(key, kind="stable")
    a, b = by[1:], by[:-1]
    equal = np.zeros(len(key), bool)
    equal[1:] = (key[a] == key[b]) & (h40[a] == h40[b]) & (name[a] == name[b])
    at = np.flatnonzero(equal)
    k, first = by[at], by[np.maximum.accumulate(np.where(equal, 0, np.arange(len(key))))[at]]
    # A document whose rows lie in several blocks sends a window once for each: these are one window.
    x, y = doc[k], doc[first]
    k = np.sort(k[(ids[x] != ids[y]) | (ths[x] != ths[y]) | (pos[k] != pos[first])])
    if not len(k):
        return None
    doc, pos = doc[k], pos[k]
    # A document stands in ids once for each block that names it: the first of equal ones is its number.
    new = np.ones(len(k), bool)
    new[1:] = (ids[doc[1:]] != ids[doc[:-1]]) | (ths[doc[1:]] != ths[doc[:-1]])
    return pa.RecordBatch.from_arrays(_marks(doc[np.flatnonzero(new)][np.cumsum(new) - 1], pos, ids, ths, homes), MARKS)


def _split(blobs: list[dict], level: int) -> pa.RecordBatch:
    """Windows of a bucket that is too large for a task, dealt to smaller ones by bits of their keys; equal windows stay together."""
    ids, ths, doc, pos, name, h40, key = _windows(blobs)
    bucket = (key >> np.uint64(64 - SPLIT_BITS * (level + 1)) & np.uint64((1 << SPLIT_BITS) - 1)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")  # by place within a bucket
    bucket, doc, pos, name, h40 = bucket[by], doc[by], pos[by], name[by], h40[by]
    ends = _cut(bucket)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    d_ends = np.searchsorted(at, ends)
    m = len(ends)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[ends - 1].astype(np.int32)),
            pa.nulls(m, pa.int32()),
            _binary(ids[doc[at]], d_ends),
            _binary(ths[doc[at]], d_ends),
            pa.nulls(m, pa.binary()),
            pa.nulls(m, pa.binary()),
            _binary(np.diff(np.append(at, len(doc))).astype(np.uint32), d_ends),
            _binary(name, ends),
            _binary(pos.astype(np.uint32), ends),
            _binary(np.ones(len(pos), np.uint8), ends),
            _binary(np.ascontiguousarray(h40).view(np.uint8).reshape(-1, 8)[:, :5], ends),
        ],
        list(COLUMNS),
    )


def _meet(it: Iterator[pa.RecordBatch], homes: int, level: int = 0, held_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """Marks of each bucket, and the windows of buckets too large for a task as rows of smaller ones. Rows come sorted by bucket; marks made in the blocks pass through."""
    held_bytes = held_bytes or HELD_BYTES
    deepest = SPLIT_BITS * (level + 1) > 64  # all bits are used: what is left together is equal

    def marks(found: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if found is not None:
            m = found.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(found.column("home")), pa.int32()), *(found.column(c) for c in MARKS), *[pa.nulls(m, pa.binary())] * 5], list(COLUMNS))

    def closed() -> Iterator[pa.RecordBatch]:
        if blobs and large:
            yield _split(blobs, level)
        elif blobs:
            yield from marks(_mark(blobs, homes))

    blobs: list[dict] = []
    bucket, size, large = None, 0, False
    for batch in it:
        own = batch.filter(batch.column("names").is_null())
        if own.num_rows:
            yield own.select(list(COLUMNS))
        for r in batch.filter(batch.column("names").is_valid()).to_pylist():
            if bucket != r["bucket"]:
                yield from closed()
                bucket, blobs, size, large = r["bucket"], [], 0, False
            blobs.append(r)
            size += sum(len(r[c]) for c in ("docs", "ths", "names", "starts", "hashes"))
            if size > held_bytes and not deepest:
                yield _split(blobs, level)
                blobs, size, large = [], 0, True
    yield from closed()


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def home_key():
    """Rows without an id are spread by their texts."""
    null_id = F.lit(NULL_ID).cast("long")
    return F.when(F.col("doc_id").isNull() | (F.col("doc_id") == null_id), F.col("th")).otherwise(F.col("doc_id"))


def repeated_windows(docs: DataFrame, homes: int, window: int = WINDOW) -> DataFrame:
    """Windows that start earlier elsewhere, as rows (home, docs, ths, runs_of, runs): packed for each home of documents.

    The binary columns hold doc_ids (64 bits, null as the least number), text hashes (64), runs of each
    document (32), and the runs: first window start and number of windows (32 each).
    """
    n = int(max(8, min(1 << 30, input_bytes(docs) // BUCKET_BYTES)))
    parts = min(n, 20_000)
    rows = doc_rows(docs).withColumn("th", text_hash())
    sent = rows.mapInArrow(lambda it: freed(_send(it, n, homes, window)), SCHEMA)
    deal = lambda df: df.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    held, level = HELD_BYTES, 0
    met = materialise(deal(sent).mapInArrow(lambda it: freed(_meet(it, homes, 0, held)), SCHEMA), "marks")
    out, rest = met.where("names is null"), met.where("names is not null")
    while not rest.isEmpty():
        level += 1
        met = materialise(deal(rest).mapInArrow(lambda it, level=level: freed(_meet(it, homes, level, held)), SCHEMA), "marks")
        out, rest = out.unionByName(met.where("names is null")), met.where("names is not null")
    return out.select(*MARKS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space; its SHA-256 with ``digest``); ``keep`` names columns to carry, text among them."""
    homes = int(max(4, min(1 << 30, input_bytes(docs) // HOME_BYTES)))
    parts = min(homes, 20_000)
    marks = repeated_windows(docs, homes, window).withColumn("late", F.lit(0))
    kinds = dict(docs.dtypes)
    texts = doc_rows(docs, *(c for c in keep if c != "text")).withColumn("th", text_hash()).withColumn("late", F.lit(1))
    texts = texts.withColumn("home", F.pmod(F.xxhash64(home_key()), F.lit(homes)).cast("int"))
    both = marks.unionByName(texts, allowMissingColumns=True).repartitionById(parts, F.col("home") % parts).sortWithinPartitions("home", "late")
    last = "kept_sha256" if digest else "kept"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, dict] = {}
        for batch in it:
            if batch.num_rows:  # rows come sorted by home
                for x in [x for x in runs if x < batch.column("home")[0].as_py()]:
                    del runs[x]
            is_text = np.asarray(batch.column("late")) == 1
            for r in batch.filter(pa.array(~is_text)).select(MARKS).to_pylist():
                at, here = 0, runs.setdefault(r["home"], {})
                for i, t, n in zip(*(np.frombuffer(r[c], k).tolist() for c, k in (("docs", np.int64), ("ths", np.int64), ("runs_of", np.uint32))), strict=True):
                    here.setdefault((i, t), []).append(r["runs"][8 * at : 8 * (at + n)])
                    at += n
            whole = batch.filter(pa.array(is_text))
            _, off = text_column(whole.column("text"))
            for i, j in slices(off):
                part = whole.slice(i, j - i)
                n_words, n_removed, kept = [], [], []
                for d, t, h, text in zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist(), part.column("home").to_pylist(), part.column("text"), strict=True):
                    w = (text.as_py() or "").encode().split()
                    n = len(w)
                    found = runs.get(h, {}).get((NULL_ID if d is None else d, t))
                    if found:
                        x = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 2).astype(np.int64)
                        gone = marked_words(x[:, 0], x[:, 1], n, window)
                        w = [y for y, g in zip(w, gone.tolist(), strict=True) if not g]
                    joined = b" ".join(w)
                    n_words.append(n)
                    n_removed.append(n - len(w))
                    kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
                cols = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *(part.column(c) for c in keep)], ["doc_id", "n_words", "n_removed", last, *keep])

    extra = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return both.mapInArrow(lambda it: freed(run(it)), f"doc_id long, n_words long, n_removed long, {last} string{extra}")
