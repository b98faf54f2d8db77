"""Operators 6 and 7 against brute force."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import neardup as ND
from stratalens.llm import recompression as RC
from stratalens.llm.components import components
from stratalens.llm.shared import spark_xxhash64
from tests.llm import brute


def passages(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = []
    for i in range(n):
        t: list[str] = []
        for _ in range(rng.randint(0, 6)):
            c = rng.random()
            if c < 0.4:
                t += [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            elif c < 0.8:
                a = rng.randint(0, 380)
                t += base[a : a + rng.choice([15, 19, 20, 21, 25, 40, 80])]
            elif c < 0.9:
                t += ["x"] * rng.randint(1, 60)
            else:
                t += ["a", "b"] * rng.randint(1, 40)
        rows.append((i * 7 % 1009, " ".join(t) if rng.random() < 0.97 else None))
    return rows


def spread(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, spans string, home int").repartition(parts)


@pytest.mark.parametrize(("seed", "block", "known", "held"), [(0, 20_000, 400_000, 48 << 20), (1, 20_000, 400_000, 3000), (2, 3_000, 400_000, 200), (3, 3_000, 50, 48 << 20)])
def test_repeats_are_what_brute_force_finds(spark, monkeypatch, seed, block, known, held):
    monkeypatch.setattr(RC, "HELD_BYTES", held)  # small ones are split by the windows' hashes, up to the last bit
    monkeypatch.setattr(RC, "BLOCK_BYTES", block)
    monkeypatch.setattr(RC, "KNOWN", known)
    rows = passages(seed, 250)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in RC.remove_repeats(spread(spark, rows), digest=True).collect()}
    assert got == brute.repeats(rows)


def test_repeats_of_a_data_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in RC.remove_repeats(df, digest=True).collect()}
    assert got == brute.repeats(rows) and sum(v[1] for v in got.values()) > 0


def test_a_phrase_of_all_texts_fills_no_task(monkeypatch):
    """What a task holds stays flat when a table doubles whose windows nearly all share one core."""
    import pyarrow as pa

    inner = RC._windows

    def one_core(h, woff, window=20):
        n = int((np.diff(woff) - window + 1).sum())
        return np.arange(n), np.arange(n) + 1, np.full(n, 7, np.uint64), None

    def largest(n):
        rng = random.Random(1)
        texts = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(9)) + " same old phrase " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(9)) for _ in range(n)]
        texts[-1] = texts[0]
        rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array(range(n), pa.int64())], ["doc_id", "text", "th"])
        held = []
        monkeypatch.setattr(RC, "cores", one_core)
        monkeypatch.setattr(RC, "_windows", lambda blobs: (held.append(sum(len(b["hashes"]) // 5 for b in blobs)), inner(blobs))[1])
        sent = [b for i in range(0, n, 50) for b in RC._send(iter([rows.slice(i, 50)]), 8, 4, 20)]
        marked, level = 0, 0
        while sent:
            met = list(RC._meet(iter(sorted(sent, key=lambda b: b.column("bucket")[0].as_py())), 4, level, 4000))
            sent, level = [r for b in met for r in (b.slice(i, 1) for i in range(b.num_rows)) if r.column("names").is_valid()[0].as_py()], level + 1
            marked += sum(int(np.frombuffer(r, np.uint32).reshape(-1, 2)[:, 1].sum()) for b in met for r in b.column("runs").drop_null().to_pylist())
        return max(held), marked

    (a, found), (b, again) = largest(800), largest(1600)
    assert b <= 1.5 * a and found == again == 2


def test_texts_without_ids_go_to_many_homes_and_lose_only_repeats(spark):
    rng = random.Random(4)
    texts = [" ".join(f"n{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(200)]
    rows = [(None, t) for t in texts] + [(1, texts[0] + " end"), (2, "begin " + texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.kept for r in RC.remove_repeats(df).collect()}
    assert got == {*texts, "end", "begin"}
    homes = [r.home for r in RC.repeated_windows(df, 64).select("home").collect()]
    keyed = df.withColumn("th", RC.text_hash()).select(F.pmod(F.xxhash64(RC.home_key()), F.lit(64)).alias("h")).distinct().count()
    assert len(set(homes)) == 2 and keyed > 50


def test_equal_windows_have_equal_cores():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 9, 3000).astype(np.uint64)
    h[500:700] = h[100:300]
    s, e, name, _ = RC.cores(h, np.array([0, 3000]))
    assert (e[:-1] == s[1:]).all() and s[0] == 0 and e[-1] == 2981
    core = np.repeat(name, e - s)
    by_window: dict = {}
    for i in range(2981):
        assert by_window.setdefault(h[i : i + 20].tobytes(), core[i]) == core[i]


def test_repeats_edge_cases(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (5, text + " more"), (6, "short"), (7, None), (8, "")]
    got = RC.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=False).collect()
    assert len(got) == 7
    removed = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got)
    assert ("None", 40, 0) in removed and removed.count(("5", 40, 40)) == 2 and ("5", 41, 40) in removed
    long = " ".join(["the same line over and over"] * 3000)
    one = RC.remove_repeats(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert one.n_removed == brute.repeats([(1, long)])[1][1]
    assert RC.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("doc_id", [5, None])
def test_copies_of_a_row_in_other_blocks_are_one_document(spark, doc_id):
    text = " ".join(f"t{i}" for i in range(40))
    again = " ".join(f"u{i}" for i in range(25))
    rows = [(doc_id, text), (doc_id, text), (doc_id, f"{again} {again}"), (doc_id, f"{again} {again}"), (9, text + " more")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = sorted((str(r.doc_id), r.kept) for r in RC.remove_repeats(df).collect())
    assert got == sorted([(str(doc_id), text)] * 2 + [(str(doc_id), again)] * 2 + [("9", "more")])


def test_a_task_sends_what_stands_everywhere_a_few_times():
    import pyarrow as pa

    line = " ".join(f"l{i}" for i in range(30))
    rng = random.Random(0)
    n = 60
    texts = pa.array([line + " " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(n)])
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), texts.slice(i, 1), pa.array([i], pa.int64())], ["doc_id", "text", "th"]) for i in range(n)]
    known = RC.Known()
    sent = np.zeros(n, int)
    for i, b in enumerate(batches):
        from stratalens.llm.shared import shingles, text_column, words

        h, woff = words(*text_column(b.column("text")))
        hashes, _ = shingles(h, woff, 20)
        k = len(hashes)
        late = known.later(hashes, np.full(k, i), np.full(k, i), np.arange(k))
        sent[i] = (~late[:11]).sum()
        assert not late[30:].any()
    assert (sent[:2] == 11).all() and (sent[3:] == 0).all()


def test_hash_of_ids_is_sparks(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 63), (1 << 63) - 1]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x long").select(F.xxhash64("x")).collect()]
    assert spark_xxhash64(np.array(ids)).tolist() == want


def families(seed: int) -> list[tuple]:
    """Families of edited copies, some so edited that only chains link them, exact copies, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randint(0, 4000)}"
    rows, i = [], 0
    for size, edits in ((60, 0.03), (40, 0.06), (25, 0.09), (3, 0.02), (2, 0.05)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            rows.append((i, " ".join(word() if rng.random() < edits else w for w in base)))
            i += 1
    chain = [word() for _ in range(100)]
    for _ in range(15):
        rows.append((i, " ".join(chain)))
        chain[rng.randint(0, 99)] = word()
        chain[rng.randint(0, 99)] = word()
        i += 1
    rows += [(i + k, rows[0][1].upper() if k % 2 else rows[0][1]) for k in range(30)]
    i += 30
    rows += [(i, None), (i + 1, ""), (i + 2, "one"), (i + 3, "ONE"), (i + 4, "one two"), (i + 5, " one\ttwo ")]
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in rows]


@pytest.mark.parametrize(("seed", "small", "block", "parts"), [(0, 16, 256, 20_000), (1, 2, 8, 20_000), (2, 4, 16, 3)])
def test_near_duplicates_are_what_brute_force_finds(spark, monkeypatch, seed, small, block, parts):
    monkeypatch.setattr(ND, "SMALL", small)
    monkeypatch.setattr(ND, "BLOCK", block)
    monkeypatch.setattr(ND, "PARTS", parts)  # fewer partitions than buckets: the keys are cut again
    monkeypatch.setattr(ND, "SPLIT_BYTES", 50_000)
    rows = families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_duplicates(spread(spark, rows).withColumnRenamed("home", "component_id"), k=2).collect()}
    assert got == brute.near(rows, 2, 80)


def test_near_duplicates_of_five_words(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = ND.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows, 5, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edge_cases(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "x y z w"), (9, "x y z w"), (2, "x y z w")]
    got = ND.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id == 9} == {2}
    assert ND.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def test_blocks_of_a_family_meet_only_where_they_share_a_rare_shingle(spark, monkeypatch):
    """A family that hangs together link by link: the pairs of blocks grow with its rows, not with their square; similar members are found."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ND, "BLOCK", 4)

    def run(n):
        common = np.arange(1, 16)
        sets = {i: np.sort(np.concatenate([common, [1000 + i, 1001 + i, 5000 + 7 * i, 50_000 + 7 * i, 90_000 + i]])).astype(np.int64) for i in range(n)}
        sets[n] = sets[n // 2].copy()  # similar enough to one other member
        sets[n][-1] = 10**6
        order = [int(x) for x in rng.permutation(n + 1)]
        stars = spark.createDataFrame([(order[0], i, 10_000 + i) for i in order], "centre long, doc long, comp long")
        held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "doc long, set binary")
        pairs = []
        inner = ND.materialise
        monkeypatch.setattr(ND, "materialise", lambda df, name="part": (out := inner(df, name), pairs.append(out.count()) if name == "family-blocks" else None)[0])
        links = {(r.a, r.b) for r in ND.large_star_links(stars, held, 80, 3).collect()}
        monkeypatch.setattr(ND, "materialise", inner)
        return pairs[0], links, (n // 2, n)

    (a, found, want), (b, again, other) = run(60), run(120)
    assert found == {want} and again == {other}
    assert b <= 2.6 * a and b < (120 / 4) ** 2 / 4


def test_a_block_is_parsed_a_few_texts_at_a_time():
    rng = np.random.default_rng(4)
    n = np.full(700, 1000)
    h = rng.integers(0, 1 << 63, int(n.sum()), dtype=np.uint64)
    ids, woff = np.arange(len(n)), np.concatenate([[0], np.cumsum(n)])
    tracemalloc.start()
    try:
        rows = list(RC._block(ids, ids, h, woff, 64, 8, RC.WINDOW, RC.Known()))
        assert tracemalloc.get_traced_memory()[1] < 110 * len(h)  # bytes a word
    finally:
        tracemalloc.stop()
    one = list(map(RC.cores, [h[a:b] for a, b in zip(woff[:3], woff[1:4], strict=True)], [np.array([0, 1000])] * 3))
    hashes, size, name = RC.parsed(h[:3000], woff[:4], RC.WINDOW)
    assert len(hashes) == size.sum() == 3 * 981 and (name == np.concatenate([x[2] for x in one])).all()
    assert sum(sum(len(b) for b in r.column("hashes").to_pylist()) for r in rows) == 5 * 700 * 981
