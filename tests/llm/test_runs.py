"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import periodic_runs
from stratalens.llm.queries import op12_periodic_runs
from stratalens.llm.shared import text_column, words
from tests.llm.brute import WORD, collapsed, runs


def found(texts, least=12):
    import pyarrow as pa

    got = periodic_runs.find_runs(*words(*text_column(pa.array(texts, pa.string()))), least)
    return [[tuple(int(v) for v in r[1:]) for r in got if r[0] == i] for i in range(len(texts))]


PIECES = st.lists(st.tuples(st.lists(st.sampled_from("ab c"), min_size=1, max_size=5), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4), st.sampled_from([2, 3, 7, 12]))
def test_runs_are_those_of_all_periods(docs, least):
    texts = [" ".join(x for part, n in doc for x in part * n) for doc in docs]
    assert found(texts, least) == [runs(t.split(), least) for t in texts]


def test_long_texts_and_large_sets():
    rng = random.Random(5)
    fib = ["a", "b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    texts = [" ".join(fib[-1]), " ".join(rng.choice("ab") for _ in range(700)), "", " ".join(bin(i).count("1") % 2 and "x" or "y" for i in range(512)), "one " * 30]
    assert found(texts) == [runs(t.split()) for t in texts]
    assert found(["w " * 30_000, "x y " * 9_000 + "z"]) == [[(0, 30_000, 1)], [(0, 18_000, 2)]]


def test_ordered_set_against_a_list():
    rng = random.Random(3)
    xs = rng.sample(range(100_000), 20_000)
    s = periodic_runs.Ordered(sorted(xs[:10]))
    for x in xs[10:]:
        s.add(x)
    want = sorted(xs)
    assert list(s) == want and len(s) == len(want)
    assert all(s.around(x) == (want[i - 1] if i else -1, want[i + 1] if i + 1 < len(want) else -1) for i, x in enumerate(want))


def test_rows_with_nulls_ties_and_other_columns(spark):
    rows = [(1, "a b " * 6 + "c", 5), (1, "a b " * 6 + "c", 5), (None, None, None), (2, "", 1), (None, "q " * 12, 2), (3, "  a\tb\n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    assert got == sorted([(1, 13, [(0, 12, 2)], "a b c")] * 2 + [(None, 0, [], ""), (2, 0, [], ""), (None, 12, [(0, 12, 1)], "q"), (3, 2, [], "a b")], key=repr)
    empty = periodic_runs.digests(periodic_runs.periodic_runs(docs.limit(0)))
    assert empty.collect() == []
    none = periodic_runs.digests(periodic_runs.periodic_runs(docs.where("doc_id = 2"))).first()
    assert (none.start, none.length, none.period, none.exponent_milli, none.n_runs) == (None, None, None, None, 0)
    assert none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_query_against_brute_force(spark, data):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    periodic = 0
    for r in op12_periodic_runs(spark, data).collect():
        w = [x.decode() for x in WORD.findall(docs.pop(r.doc_id).encode())]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1500 and h % 10:
            continue  # the search over all periods is quadratic; the SQL test has these
        want = runs(w) if len(w) <= 1500 else None
        if want is None:
            continue
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(w, want)).encode()).hexdigest()
        periodic += h % 10 == 0 and bool(want)
    assert not docs and periodic > 5


def test_suffixes_are_sorted():
    h = np.array([3, 1, 3, 1, 3, 1, 2, 9, 9], np.uint64)
    sa, lcp = periodic_runs.sorted_suffixes(np.array([0] * 6 + [1] * 3), np.array([6] * 6 + [9] * 3), h)
    assert sa.tolist() == [5, 3, 1, 4, 2, 0, 6, 8, 7]
    assert lcp.tolist() == [0, 1, 3, 0, 2, 4, 0, 0, 1]
