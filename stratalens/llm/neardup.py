"""MinHash near-dedup with tensored banding (operator 7).

A text's set is its distinct k-word shingles (ASCII letters in lower case). Instead of one band of
2r hashes for each of m x m tables, two collections of m bands of r hashes are drawn and table
(i, j) is keyed by band i of the first and band j of the second: 2mr MinHash values make m^2 keys.
With m = 12 and r = 3, 72 values make 144 tables, and two sets of similarity 0.8 meet in one with
probability (1 - (1 - 0.8^3)^12)^2 = 0.9996, higher similarities almost surely.

Texts with equal sets are one class first, and only its representative (least doc_id) goes on, so
copies, however many, cost one row each. The keys of a block of texts are packed for each partition, where
they are cut into buckets of key values; texts that share a key are linked in a star to the least of
them. So rows stay large however many buckets there are. Stars are confirmed on full sets, and
components of the links found:

1. every member of a star against its centre; a star of many members is dealt to several tasks, each with the centre's set;
2. where a star still spans several components, all its pairs across components, if it is small; else
   by prefix filtering among the members of such stars that share members: two sets as similar as asked share one of
   the few rarest shingles of each, so members that share none of these across components drop out
   before sets move, and what is left falls into families that do. In a family, members in the order
   of component and size are cut in blocks, and two blocks meet unless both lie in one component or
   their sizes are too far apart. Sets meet in the blocks; only links leave them.

All texts that share a key lie in one star, so no pair that meets in a table and could join two
components goes untested, and no task lists the pairs of a large group. Links, components and sets
stay in tables; nothing of them goes to the driver.

Texts without a word have an empty set and stay alone. Rows with a null doc_id are linked with
nothing (component_id null, kept). Rows that share a doc_id are one node, linked by any of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.components import components
from stratalens.llm.shared import batches, doc_rows, forget, freed, input_bytes, join_hot, materialise, mix, shingles, words

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 12, 3
#: Stored input that meets in a bucket of keys; members up to which all pairs of a star are listed; members of a block, and of a star that a task takes; elements of sets that are compared at a time.
BUCKET_BYTES, SMALL, BLOCK, ELEMENTS = 6 << 20, 16, 256, 4096
#: Partitions at most; each takes one bucket after the other, so their number doesn't bound that of buckets. Bytes that are cut into buckets at a time.
PARTS, SPLIT_BYTES = 20_000, 64 << 20

_rng = np.random.default_rng(0xBA4D)
_XOR = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64)
_MUL = _rng.integers(1 << 62, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted distinct values of a small array."""
    s = np.sort(s)
    if len(s) > 1:
        first = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=first[1:])
        s = s[first]
    return s


def bands(s: np.ndarray, soff: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """(texts x 2 n_bands) band keys; texts without shingles have arbitrary ones."""
    n = len(soff) - 1
    out = np.zeros((n, 2 * n_bands), np.uint64)
    some = np.flatnonzero(np.diff(soff))
    if not len(some):
        return out
    at = soff[:-1][some]
    for band in range(2 * n_bands):
        key = np.full(len(some), band + 1, np.uint64)
        for r in range(rows):
            i = band * rows + r
            v = s ^ _XOR[i]
            v *= _MUL[i]
            v ^= v >> np.uint64(29)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(v, at))
        out[some, band] = key
    return out


def _profile(it: Iterator[pa.RecordBatch], k: int, n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for part, buf, off in batches(it, "text"):
        h, woff = words(buf, off, lower=True)
        s, soff = shingles(h, woff, k)
        n = np.zeros(part.num_rows, np.int64)
        sums = np.zeros((part.num_rows, 2), np.uint64)
        for i in range(part.num_rows):
            u = distinct(s[soff[i] : soff[i + 1]])
            n[i] = len(u)
            sums[i, 0] = np.add.reduce(u)
            sums[i, 1] = np.add.reduce(u ^ (u >> np.uint64(17)) * np.uint64(0xC2B2AE3D27D4EB4F))
        keys = bands(s, soff, n_bands, rows)
        size = keys.shape[1] * 8
        packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((np.arange(part.num_rows + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(keys.tobytes())])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), packed], ["doc_id", "n", "s1", "s2", "bands"])


def _sets(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part, buf, off in batches(it, "text"):
        h, woff = words(buf, off, lower=True)
        s, soff = shingles(h, woff, k)
        sets = [distinct(s[soff[i] : soff[i + 1]]).tobytes() for i in range(part.num_rows)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc", "set"])


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], ends * 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _by_number(number: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct numbers, ends of their stretches, the columns in the order of numbers)."""
    by = np.argsort(number, kind="stable")
    n = number[by]
    last = np.ones(len(n), bool)
    last[:-1] = n[1:] != n[:-1]
    ends = np.flatnonzero(last) + 1
    return n[ends - 1], ends, [c[by] for c in columns]


def _keys(it: Iterator[pa.RecordBatch], n_bands: int, n_buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Table keys of representatives, packed for each partition of buckets."""
    for batch in it:
        for at in range(0, batch.num_rows, 6000):
            rows = batch.slice(at, 6000)
            ids = np.asarray(rows.column("doc_id"))
            b = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint64).reshape(len(ids), 2, n_bands)
            table = np.arange(n_bands * n_bands, dtype=np.uint64).reshape(1, n_bands, n_bands)
            key = mix(b[:, 0, :, None] * np.uint64(0x9E3779B97F4A7C15) + b[:, 1, None, :] * np.uint64(0xC2B2AE3D27D4EB4F) + table).reshape(-1)
            part, ends, (key, doc) = _by_number((key % np.uint64(n_buckets) % np.uint64(parts)).astype(np.int32), key, np.repeat(ids, n_bands * n_bands))
            yield pa.RecordBatch.from_arrays([pa.array(part), _packed(key, ends), _packed(doc, ends)], ["part", "keys", "docs"])


def _split(it: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition cut into its buckets, so many bytes at a time."""
    keys: list[bytes] = []
    docs: list[bytes] = []
    size = 0

    def cut() -> pa.RecordBatch:
        key, doc = np.frombuffer(b"".join(keys), np.uint64), _ids(b"".join(docs))
        bucket, ends, (key, doc) = _by_number((key % np.uint64(n_buckets)).astype(np.int32), key, doc)
        return pa.RecordBatch.from_arrays([pa.array(bucket), _packed(key, ends), _packed(doc, ends)], ["bucket", "keys", "docs"])

    for batch in it:
        for k, d in zip(batch.column("keys").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            keys.append(k)
            docs.append(d)
            size += 2 * len(k)
            if size >= SPLIT_BYTES:
                yield cut()
                keys, docs, size = [], [], 0
    if keys:
        yield cut()


def _stars(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the least text of a key with each other one, packed for each partition of pairs; rows come sorted by bucket."""

    def met(keys: list[bytes], docs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, doc = np.frombuffer(b"".join(keys), np.uint64), _ids(b"".join(docs))
        by = np.lexsort((doc, key))
        key, doc = key[by], doc[by]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        centre = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        pair = centre != doc
        a, b = _unique_pairs(centre[pair], doc[pair])
        if not len(a):
            return
        part = (mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        part, ends, (a, b) = _by_number(part, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(part), _packed(a, ends), _packed(b, ends)], ["part", "a", "b"])

    keys: list[bytes] = []
    docs: list[bytes] = []
    bucket = None
    for batch in it:
        for r in batch.to_pylist():
            if keys and r["bucket"] != bucket:
                yield from met(keys, docs)
                keys, docs = [], []
            bucket = r["bucket"]
            keys.append(r["keys"])
            docs.append(r["docs"])
    if keys:
        yield from met(keys, docs)


def _unpack_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs as rows; of those that lie in one stretch of so many bytes each once."""
    a: list[bytes] = []
    b: list[bytes] = []
    size = 0
    for batch in it:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a.append(x)
            b.append(y)
            size += 2 * len(x)
            if size >= SPLIT_BYTES:
                yield _pair_rows(_ids(b"".join(a)), _ids(b"".join(b)))
                a, b, size = [], [], 0
    if a:
        yield _pair_rows(_ids(b"".join(a)), _ids(b"".join(b)))


def _first_of_equal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair once; pairs come sorted."""
    last = None
    for batch in it:
        a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        if not len(a):
            continue
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first[0] = last != (a[0], b[0])
        last = (a[-1], b[-1])
        yield batch.filter(pa.array(first))


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = _unique_pairs(a.astype(np.int64), b.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: b's set travels to a's, where the two meet.

    The pairs of one a are dealt to as many places as hold ``BLOCK`` of them each; a's set goes to all of these.
    """
    many = pairs.groupBy("a").count().where(F.col("count") > BLOCK).select("a", F.ceil(F.col("count") / BLOCK).alias("places"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("places")), F.lit(0)).alias("place"))
    withb = sets.select(F.col("doc").alias("b"), "set").join(dealt.hint("merge"), "b").select("a", "place", "b", "set")
    centres = sets.select(F.col("doc").alias("a"), "set").join(dealt.select("a", "place").distinct().hint("merge"), "a").select("a", "place", F.lit(None).cast("long").alias("b"), "set")
    both = centres.unionByName(withb).repartition(parts, "a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())

    def test(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in it:
            out = []
            for a, place, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "place", "b")), batch.column("set"), strict=True):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                if (a, place) != at:
                    at, own = (a, place), []
                if b is None:
                    own.append(x.copy())
                    continue
                for y in own:
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    if len(small) * 100 < percent * len(large) or not len(small):
                        continue
                    i = np.searchsorted(large, small)
                    i[i == len(large)] = 0
                    common = int((large[i] == small).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((a, b))
                        break
            yield _pair_rows(np.array([p[0] for p in out], np.int64), np.array([p[1] for p in out], np.int64))

    return both.mapInArrow(lambda it: freed(test(it)), "a long, b long")


def _cross_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components of small stars; pairs with the centre were tested before."""
    for batch in it:
        a, b = [], []
        for members, comps in zip(batch.column("ids").to_pylist(), batch.column("comps").to_pylist(), strict=True):
            order = np.argsort(members)
            m, c = np.array(members, np.int64)[order], np.array(comps, np.int64)[order]
            i, j = np.triu_indices(len(m), 1)
            new = c[i] != c[j]
            a.append(m[i[new]])
            b.append(m[j[new]])
        if a:
            yield _pair_rows(np.concatenate(a), np.concatenate(b))


def _block_links(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the two sides of each pair of blocks; rows come sorted by pair, left side first."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(rows)), size)
        by = np.argsort(values, kind="stable")
        values, owner = values[by], owner[by]
        element = np.cumsum(np.append(False, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
        left = np.array([r[1] == 0 for r in rows])
        x = np.flatnonzero(left)
        y = np.flatnonzero(~left) if (~left).any() else x
        common = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, int(element[-1]) + 1 if len(element) else 0, ELEMENTS):  # so many elements at a time
            i, j = np.searchsorted(element, [at, at + ELEMENTS])
            matrix = np.zeros((len(rows), ELEMENTS), np.float32)
            matrix[owner[i:j], element[i:j] - at] = 1
            common += matrix[x] @ matrix[y].T
        ok = 100 * common >= percent * (size[x][:, None] + size[y][None, :] - common)
        ids, comp = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        ok &= comp[x][:, None] != comp[y][None, :]
        i, j = np.nonzero(ok)
        a, b = ids[x[i]], ids[y[j]]
        ca, cb = comp[x[i]], comp[y[j]]
        _, one = np.unique(np.stack([np.minimum(ca, cb), np.maximum(ca, cb)], axis=1), axis=0, return_index=True) if len(a) else (None, np.zeros(0, int))
        return _pair_rows(np.minimum(a[one], b[one]), np.maximum(a[one], b[one]))

    held: list[tuple] = []
    for batch in it:
        for r in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "doc", "comp", "set")), strict=True):
            if held and r[0] != held[0][0]:
                yield links(held)
                held = []
            held.append(r)
    if held:
        yield links(held)


def rare_families(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc, comp, n, family), and (doc, comp, n, group, root) for the rare shingles that members of several components hold: of the members (doc, comp, stars) that share one of their rarest shingles with a member of another component among the same ``stars``; those who share one directly or through others are a family.

    Of a set of n shingles, in the order of their frequency among the members, the first n - ceil(percent n / 100) + 1
    are its rarest: a set similar enough holds one of these among its own.
    """

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc, comp, stars, s in zip(*(batch.column(c) for c in ("doc", "comp", "stars", "set")), strict=True):
                x = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), v.as_py(), np.int64)) for v in (doc, comp, stars)] + [pa.array(x)], ["doc", "comp", "stars", "e"])

    held = members.join(sets, "doc").select("doc", "comp", "stars", "set").mapInArrow(explode, "doc long, comp long, stars long, e long")
    often = held.groupBy("e").agg(F.count("*").alias("c"))
    ordered = held.join(often, "e").groupBy("doc", "comp", "stars").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("s"), F.count("*").alias("n"))  # a document's own shingles
    rare = materialise(ordered.select("doc", "comp", "stars", "n", F.explode(F.slice("s", F.lit(1), F.col("n").cast("int") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)).alias("x")).select("doc", "comp", "stars", "n", F.col("x.e").alias("e")), "rare")
    across = rare.groupBy("stars", "e").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("doc").alias("root")).where("lo < hi").select("stars", "e", "root")
    shared = materialise(rare.join(across, ["stars", "e"]).select("doc", "comp", "n", "root", F.xxhash64("stars", "e").alias("group")), "rare-shared")
    forget(rare)
    family = components(shared.select(F.col("doc").alias("a"), F.col("root").alias("b")).distinct())
    out = shared.select("doc", "comp", "n").distinct().join(family.select(F.col("node").alias("doc"), F.col("component").alias("family")), "doc")
    return out, shared


def large_star_links(stars: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links across components inside large stars (centre, doc, comp)."""
    reach = components(stars.where("centre <> doc").select(F.col("doc").alias("a"), F.col("centre").alias("b")))  # stars that share members
    members, shared = rare_families(stars.select("doc", "comp").distinct().join(reach.select(F.col("node").alias("doc"), F.col("component").alias("stars")), "doc"), sets, percent)
    # Places in one order of all members, from the sizes of its ranges (a row each), name the blocks; no family is numbered in one task.
    order = ["family", "comp", "n", "doc"]
    docs = members.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = materialise(docs.withColumn("range", F.shiftright("id", 33)), "family-docs")
    ranges = placed.groupBy("range").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    ranges = ranges.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows") - F.col("least")).alias("shift"))
    docs = placed.join(F.broadcast(ranges), "range").select(*order, F.floor((F.col("id") + F.col("shift")) / BLOCK).alias("block"))
    # Two blocks meet where they share a rare shingle across components, among members of near sizes: as many pairs as shingles tie, not all of a family.
    placed_at = docs.select("doc", "family", "block")
    per = shared.join(placed_at, "doc").groupBy("group", "family", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    other = per.select("group", "family", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "least", "most")])
    near = (F.col("most") * 100 >= F.col("least2") * percent) & (F.col("most2") * 100 >= F.col("least") * percent)
    meet = per.join(other, ["group", "family"]).where("block <= block2 and not (lo = hi and lo = lo2 and lo = hi2)").where(near)
    meet = materialise(meet.select("family", "block", "block2").distinct().select("*", F.xxhash64("family", "block", "block2").alias("pair")), "family-blocks")
    side = lambda n, c: meet.select("family", F.col(c).alias("block"), "pair", F.lit(n).alias("side"))
    sides = side(0, "block").unionByName(side(1, "block2").join(meet.where("block = block2").select("pair"), "pair", "left_anti").select("family", "block", "pair", "side"))
    rows = sides.join(docs, ["family", "block"]).join(sets, "doc").select("pair", "side", "doc", "comp", "set")
    rows = rows.repartition(parts, "pair").sortWithinPartitions("pair", "side")
    found = materialise(rows.mapInArrow(lambda it: freed(_block_links(it, percent)), "a long, b long"), "family-links")
    forget(shared, placed, meet, reach)
    return found


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document: components of links with 100 x intersection >= percent x union."""
    texts = doc_rows(docs)
    profile = materialise(texts.mapInArrow(lambda it: _profile(it, k, n_bands, rows), "doc_id long, n long, s1 long, s2 long, bands binary"), "profiles")
    some = profile.where("doc_id is not null and n > 0")
    classes = materialise(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    n_buckets = int(max(8, min(1 << 30, input_bytes(docs) // BUCKET_BYTES)))
    parts = min(n_buckets, PARTS)
    dealt = lambda df: df.repartitionById(parts, F.col("part"))
    first = classes.select(F.col("rep").alias("doc_id"), "s1", "s2").join(some, ["doc_id", "s1", "s2"]).select("doc_id", "bands")
    sent = dealt(first.mapInArrow(lambda it: freed(_keys(it, n_bands, n_buckets, parts)), "part int, keys binary, docs binary"))
    cut = sent.mapInArrow(lambda it: freed(_split(it, n_buckets)), "bucket int, keys binary, docs binary") if n_buckets > parts else sent.withColumnRenamed("part", "bucket")
    starred = dealt(cut.sortWithinPartitions("bucket").mapInArrow(lambda it: freed(_stars(it, parts)), "part int, a binary, b binary"))
    pairs = starred.mapInArrow(lambda it: freed(_unpack_pairs(it)), "a long, b long").sortWithinPartitions("a", "b").mapInArrow(lambda it: freed(_first_of_equal(it)), "a long, b long")
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    # Merge joins spill, and move the same at every size.
    sets = texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("doc")).select("doc_id", "text").mapInArrow(lambda it: _sets(it, k), "doc long, set binary")
    sets = materialise(sets, "sets")
    links = materialise(confirm(pairs, sets, percent, parts), "links")
    labels = components(links)

    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    stars = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    open_ = stars.groupBy("a").agg(F.max((F.col("ca") != F.col("cb")).cast("int")).alias("broken"), (F.count("*") + 1).alias("size"), F.min("ca").alias("ca")).where("broken = 1 and size > 2")
    open_ = stars.select("a", "b", "cb").join(open_.select("a", "size"), "a").select(F.col("a").alias("centre"), F.col("b").alias("doc"), F.col("cb").alias("comp"), "size").unionByName(
        open_.select(F.col("a").alias("centre"), F.col("a").alias("doc"), F.col("ca").alias("comp"), "size")
    )
    open_ = materialise(open_, "open")
    small = open_.where((F.col("size") <= SMALL) & (F.col("centre") != F.col("doc"))).groupBy("centre").agg(F.collect_list(F.struct("doc", "comp")).alias("m")).select(F.col("m.doc").alias("ids"), F.col("m.comp").alias("comps"))
    cross = materialise(small.mapInArrow(_cross_pairs, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "cross-pairs")
    more = confirm(cross, sets, percent, parts)
    large = open_.where(F.col("size") > SMALL).select("centre", "doc", "comp")
    far = None
    if not large.isEmpty():
        far = large_star_links(large, sets, percent, parts)
        more = more.unionByName(far)
    more = materialise(more, "more-links")
    if not more.isEmpty():
        before, labels = labels, components(links.unionByName(more))
        forget(before)
    forget(pairs, sets, links, open_, cross, more, *([far] if far is not None else []))  # the result reads profiles, classes and components only

    total = some.count()
    # Components are those of representatives: a class of many copies asks once.
    rep = classes.join(labels, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", "copies", F.coalesce("component", "rep").alias("component_id"))
    rep = join_hot(some.select("doc_id", "n", "s1", "s2"), rep, ["s1", "s2", "n"], "copies", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = profile.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rep.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
