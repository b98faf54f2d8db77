"""Phrases against plain counts, with and without collisions of fingerprints."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import collocations
from stratalens.llm.shared import text_column

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs: list[tuple], longest: int) -> tuple[Counter, Counter]:
    """((language, words): occurrences, language: words)."""
    grams, words = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            grams.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return grams, words


def mined(docs: list[tuple], least: int, longest: int, top: int, within: int) -> set[tuple]:
    grams, words = counts(docs, longest)
    langs = defaultdict(list)
    for (lang, p), a in grams.items():
        if len(p) < 2 or a < least:
            continue
        if any(100 * b >= within * a and b >= least and lang == x and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in grams.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (grams[lang, p[:k]] * grams[lang, p[k:]]), k, grams[lang, p[:k]], grams[lang, p[k:]]) for k in range(1, len(p)))
        langs[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for lang, xs in langs.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top])}


TEXTS = st.lists(st.tuples(st.lists(st.sampled_from(["a", "B", "b", "ab", " ", "  ", "\t", ",", "\n", "é", "Ä", "\x0b", "longer", "."]), max_size=25).map("".join), st.sampled_from(["en", "de"])), min_size=1, max_size=6)


def in_block(docs, longest, frequent=None) -> Counter:
    table = collocations.Table(*text_column(pa.array([t for t, _ in docs], pa.string())), [x for _, x in docs], longest)
    got: Counter = Counter()
    for lang, phrase, n in table.phrases(np.ones(len(table.keys), bool)):
        for x, p, c in zip(lang.to_pylist(), phrase.to_pylist(), n.tolist(), strict=True):
            got[x, tuple(p.split(" "))] += c
    return got


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_a_block_counts_phrases_within_pieces(docs, longest):
    assert in_block(docs, longest) == counts(docs, longest)[0]


def test_collisions_of_fingerprints_and_of_word_hashes_change_nothing(monkeypatch):
    rng = random.Random(1)
    docs = [(" ".join(rng.choice(["a", "b", "cc", "dd", "e,", "é"]) for _ in range(80)), rng.choice(["en", "de"])) for _ in range(20)]
    monkeypatch.setattr(collocations, "mix", lambda x: x % np.uint64(7))
    assert in_block(docs, 3) == counts(docs, 3)[0]


def test_prefix_polynomials_do_not_depend_on_the_place():
    same = "x y z"
    a = collocations.Table(*text_column(pa.array([same])), ["en"], 3)
    b = collocations.Table(*text_column(pa.array(["q r s t. " * 50 + same + ", u"])), ["en"], 3)
    c = collocations.Table(*text_column(pa.array([same])), ["fr"], 3)
    assert set(a.keys.tolist()) <= set(b.keys.tolist()) and not set(a.keys.tolist()) & set(c.keys.tolist())


def test_mining_with_nulls_repeats_and_other_columns(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "sat", "on", "mat.", "mat", "x,", "\n", "é"]) for _ in range(rng.choice([0, 5, 60]))), rng.choice(["en", "fr", None, "und"]), "p", 1) for i in range(120)]
    rows += [(None, None, "en", "q", 2), (1, None, None, None, None), (2, "w " * 3000, "zz", "q", 1), *[(5, "gold ring here", "aa", "r", 1)] * 12]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    for least, longest, top, within in ((10, 3, 2000, 50), (2, 4, 15, 80), (3, 2, 5, 50)):
        got = {tuple(r) for r in collocations.collocations(df, least, longest, top, within).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
        assert got == mined([(r[1], r[2]) for r in rows], least, longest, top, within)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_scores_pass_64_bits(spark, monkeypatch):
    many = 10**12
    counted = spark.createDataFrame([("en", "a", 3 * many), ("en", "b", 7 * many), ("en", "a b", many + 1), ("en", None, 90 * many)], "lang string, phrase string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: counted)
    r = collocations.collocations(counted).first()
    assert (r.score, r.rank, r.n) == (10**6 * (many + 1) ** 2 // (21 * many**2), 1, 90 * many)
