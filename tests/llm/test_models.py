"""Operators 8, 9 and 10: held-out accuracy, brute force, edge cases."""

from __future__ import annotations

import random
import zlib

import pytest

from stratalens.llm import languages as LG
from stratalens.llm import lm_scores as LM
from stratalens.llm import toxicity as TX
from tests.llm import brute


@pytest.fixture(scope="module")
def text_model(spark, data):
    return LG.fit(spark.read.parquet(f"{data}/documents.parquet"))


def test_languages_of_documents(text_model, spark):
    """Texts of another scale's table, wrapped in pages whose tags say nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").limit(300).collect()
    pages = spark.createDataFrame([(r.doc_id, f"http://host{r.doc_id % 7}.example.com/x", f"<html><body>{r.text}</body></html>") for r in docs], "page_id long, url string, html string")
    got = {r.page_id: r.language for r in LG.identify(pages, text_model).collect()}
    right = sum(got[r.doc_id] == r.lang for r in docs)
    assert right >= 0.97 * len(docs)


def test_priors_and_tags_decide_where_the_text_does_not(text_model, spark):
    german = "Der Einungen und die Achlichkeit einer Heit mit verschen geen. " * 4
    english = "The thing and that other was in the hand of this one. " * 4
    rows = [(i, f"http://seite.example.de/{i}", f'<html lang="de"><p>{german}</p></html>') for i in range(30)]
    rows += [(100 + i, f"http://page.example.com/{i}", f'<html lang="en"><p>{english}</p></html>') for i in range(30)]
    rows += [(200, "http://seite.example.de/leer", "<html></html>"), (201, "http://page.example.com/none", None), (202, None, '<html lang="de"></html>'), (203, "", ""), (203, "", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, language string")
    got = {r.page_id: r for r in LG.identify(df, text_model).collect()}
    assert got[200].language == "de" and got[201].language == "en" and got[202].language == "de"
    assert got[200].text_language is None and abs(sum(got[200].posteriors.values()) - 1) < 1e-6
    assert LG.identify(df, text_model).count() == len(rows)
    assert LG.identify(df.limit(0), text_model).count() == 0
    assert LG.identify(df, None).where("language is null").count() == len(rows)


def test_every_labelled_language_counts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b for a in letters[:10] for b in letters[:7]]
    text = lambda n: f"{n}{n} {n[::-1]}{n} {n}q{n} " * 20
    docs = spark.createDataFrame([(i, text(n), n) for i, n in enumerate(names * 2) if i < 140 - (n == "jg")], "doc_id long, text string, lang string")
    model = LG.fit(docs)
    assert model.names == names
    pages = spark.createDataFrame([(1, None, f"<p>{text('jg')}</p>"), (2, None, f"<p>{text('ac')}</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.language for r in LG.identify(pages, model).collect()} == {1: "jg", 2: "ac"}


def test_page_parts():
    assert LG.address("https://user@m.Blog.example.co.uk:8080/de-AT/x?q#f") == ("m.blog.example.co.uk", "blog.example.co.uk", "co.uk", "uk", "de")
    assert LG.address("") == ("", "", "", "", "") and LG.address("http://10.0.0.1/fr/") == ("10.0.0.1", "10.0.0.1", "10.0.0.1", "", "fr")
    assert LG.parse('<HTML xml:lang="ES-mx">')[1] == "es" and LG.parse("<p>")[1] == ""
    assert LG.parse('<meta property="og:locale" content="fr_FR"><html lang=de>')[1] == "de" and LG.parse('<meta property="og:locale" content="fr_FR">')[1] == "fr"
    assert LG.parse("<style>a</style><nav>menu</nav><p>a &amp; b</p>")[0].split() == ["a", "&", "b"]
    assert LG.parse('x<!-- <p>no</p> -->y<div class="ads">buy</div><div class="main">z</DIV >')[0].split() == ["x", "y", "z"]
    assert LG.parse("<!-- open <b>a</b> <script>b")[0].split() == ["a", "b"] and LG.parse("a < b")[0] == "a < b"
    assert LG.parse("&#" + "1" * 9000 + "; x")[0].split() == ["\ufffd", "x"]


@pytest.mark.parametrize("unit", ["<html ", "<!--", "<script>", "</script", "<div class=ad>", "<meta og:locale ", "<", "&#1", "<nav></nav ", "lang  ", "<a b='", "<style><!--"])
def test_hostile_pages_take_linear_time(unit):
    import time

    for closed in ("", ">"):
        page = unit * ((1 << 20) // len(unit)) + closed
        start = time.time()
        LG.parse(page)
        LG.address(page)
        assert time.time() - start < 2.5


def test_posteriors_are_what_brute_force_finds(text_model, spark):
    """Every posterior from its definition, page by page, over pages with all kinds of evidence and none."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").limit(60).collect()
    rng = random.Random(3)
    hosts = ["", "a.example.de", "b.example.de", "shop.b.example.de", "x.co.uk", "big.example.com", "10.0.0.1", "localhost"]
    rows = []
    for i in range(220):
        d = rng.choice(docs)
        host = rng.choice(hosts) if rng.random() < 0.6 else "big.example.com"
        lang = rng.choice(["", f' lang="{d.lang}"', ' lang="en"'])
        words = d.text.split()[: rng.choice([0, 2, 5, 60])]
        rows.append((i, f"http://{host}/{rng.choice(['de', 'fr', 'x', ''])}/{i}" if host else None, f"<html{lang}><p>{' '.join(words)}</p></html>"))
    got = {r.page_id: r for r in LG.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), text_model).collect()}

    names, n = text_model.names, len(text_model.names)
    pages = []
    for i, url, source in rows:
        text, declared = LG.parse(source)
        host, parent, domain, suffix, code = LG.address(url or "")
        low = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 else b for b in text.encode())
        like = [0.0] * n
        for k in range(len(low)):
            grams = [low[k], (low[k] | low[k - 1] << 8 if k else low[k]) | 1 << 24, low[k] | (low[k - 1] << 8 if k else 0) | (low[k - 2] << 16 if k > 1 else 0) | 2 << 24]
            for g in grams:
                for l in range(n):
                    like[l] += float(text_model.table[(g * 0x9E3779B1 & 0xFFFFFFFF) >> 16, l])
        like = [x * LG.TEMPER / 3 for x in like]
        like = [max(x - max(like), -LG.MOST) for x in like]
        share = [math.exp(x) / sum(map(math.exp, like)) for x in like]
        pages.append({"id": i, "host": host, "parent": parent, "domain": domain, "suffix": suffix, "code": code, "declared": declared, "like": like, "share": share})
    for p in pages:
        others = lambda c: [sum(q["share"][l] for q in pages if q is not p and (c is None or q[c] == p[c])) for l in range(n)]  # noqa: E731, B023
        everyone = others(None)
        prior = [(x + 1) / (sum(everyone) + n) for x in everyone]
        for c in ("domain", "parent", "host"):
            if p[c]:
                own = others(c)
                prior = [(a + LG.STRENGTH * b) / (sum(own) + LG.STRENGTH) for a, b in zip(own, prior, strict=True)]
        logs = [a + math.log(b) for a, b in zip(p["like"], prior, strict=True)]
        for c in ("declared", "suffix", "code"):
            if p[c]:
                kinds = len({q[c] for q in pages})
                logs = [x + math.log((a + 1) / (b + kinds)) for x, a, b in zip(logs, others(c), everyone, strict=True)]
        post = [math.exp(x - max(logs)) for x in logs]
        for name, x in zip(names, post, strict=True):
            assert abs(got[p["id"]].posteriors[name] - x / sum(post)) < 5e-9


def test_toxicity_holds_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = TX.fit(docs, labels)
    rows = TX.score(docs, *model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.01 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = {"idiot": 1.0, "worthless": 1.0, "scum": 1.0, "stupid": 1.0, "trash": 1.0}
    lexicon, rng = TX.FuzzyLexicon(terms), random.Random(0)
    for _ in range(3000):
        w = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(0, 3)):
            k, c = rng.randrange(len(w) + 1), rng.choice("abcdeiorstuw")
            w[k : k + rng.randint(0, 1)] = [c] if rng.random() < 0.6 else []
        w = "".join(w)
        want = min(((distance(w, t), t) for t in terms if distance(w, t) <= lexicon.edits[t]), default=None)
        got = lexicon.match(w)
        assert (got is None) == (want is None) and (got is None or got[1] == want[0])


def test_stems_and_contexts():
    s = TX.Scorer({"idiot": 5.0, "lowei*": 4.0}, [0.0] * 10)
    assert s.lexicon.match("loweischaft") == ("lowei*", 0) and s.lexicon.match("lowei") is None and s.lexicon.match("idiots") == ("idiot", 1)
    quoted, abuse = s.features('he said the word "idiot" was used')[6], s.features("you idiot!")[7]
    assert quoted == 1 and abuse == 1 and s.features("you are nice") == [0.0] * 9


def plain_features(terms: dict[str, float], text: str) -> list[float]:
    """The inputs of the regression from their definition: every word against every term."""
    import math
    import re

    low = text.lower()
    found = [(m[0], m.span()) for m in re.finditer(r"[^\W\d_]+", low)]
    words = [w for w, _ in found]
    allowed = lambda t: (0 if len(t) < 7 else 1) if t.endswith("*") else 0 if len(t) < 5 else 1 if len(t) < 9 else 2

    def match(w):
        whole = min(((distance(w, t), t) for t in terms if not t.endswith("*") and distance(w, t) <= allowed(t)), default=None)
        stem = None
        for t in (x for x in terms if x.endswith("*")):
            for k in range(1, len(w)):
                e = distance(w[:k], t[:-1])
                if e <= allowed(t):
                    stem = min(x for x in (stem, (e, k, t)) if x is not None)
        if whole and (stem is None or whole[0] <= stem[0]):
            return whole[1], whole[0]
        return (stem[2], stem[0]) if stem else None

    hits = [(i, *m) for i, w in enumerate(words) if (m := match(w))]
    if not hits:
        return [0.0] * 9
    quoted = address = 0
    for i, _, _ in hits:
        a, b = found[i][1]
        near = words[max(0, i - 6) : i] + words[i + 1 : i + 7]
        quoted += bool(set(low[max(0, a - 2) : a]) & set(TX.QUOTE_MARKS) and set(low[b : b + 3]) & set(TX.QUOTE_MARKS)) or bool(set(near) & TX.REPORTING)
        address += bool(set(near) & TX.ADDRESS) or "!" in low[b : b + 3]
    n = len(hits)
    count = lambda x: math.log1p(sum(x))
    return [math.log1p(n), math.log1p(len({t for _, t, _ in hits})), count(e == 0 for _, _, e in hits), count(e > 0 for _, _, e in hits), max(terms[t] / (1 + e) for _, t, e in hits), math.log1p(100 * n / len(words)), quoted / n, address / n, count(t.endswith("*") for _, t, _ in hits)]


def test_scores_are_what_brute_force_finds(spark):
    import math

    terms = {"idiot": 2.0, "worthless": 1.5, "scum": 3.0, "lowei*": 1.2, "trashi*": 2.2, "fool": 1.0}
    coefficients = [-2.0, 0.7, 0.3, 0.4, -0.2, 0.5, 0.1, -1.5, 0.9, 0.2]
    rng = random.Random(8)
    words = ["you", "idiot", "idiots", "idoit", "worthles", "wortless", "scum", "scums", "loweischaft", "lowe", "trashing", "trashhing", "fool", "fools", "said", '"idiot"', "fool!", "the", "a", "fine", "day", "your", "„scum“", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["", "word " * 50_000 + "idiot"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in TX.score(df, terms, coefficients).collect()}
    for i, t in enumerate(texts[:-1]):
        x = coefficients[0] + sum(c * f for c, f in zip(coefficients[1:], plain_features(terms, t), strict=True))
        assert abs(got[i].score - 1 / (1 + math.exp(-x))) < 1e-8 and got[i].predicted == int(got[i].score >= 0.7)
    assert got[len(texts) - 1].score > got[len(texts) - 2].score  # one hit at the end of a very long text


def test_automaton_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(TX, "MOVES", 20)
    lexicon = TX.FuzzyLexicon({"worthless": 1.0, "idiot": 1.0})
    for w in ["worthles", "idiott", "abcdefgh", "worthlessx", "wxrthlxss"] * 5:
        want = min(((distance(w, t), t) for t in ("worthless", "idiot") if distance(w, t) <= lexicon.edits[t]), default=None)
        assert (lexicon.match(w) or None) == (want and (want[1], want[0]))
        assert lexicon.made <= 40


def test_one_text_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(i, t) for i in range(60) for t in (("you stupid clown", "a nice day") if i % 2 else ("a fine day", "a fine day"))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert TX.fit(docs, labels) == TX.fit(docs.repartition(5), labels)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, "you stupid clown" if i % 3 == 0 else "a fine day it is", 0.5) for i in range(90)] + [(None, None, 0.1), (400, "", 0.1), (400, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = TX.score(docs, *TX.fit(docs, labels)).collect()
    assert len(got) == 93
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 90)
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 400))
    none = TX.score(docs, *TX.fit(docs, labels.limit(0))).agg({"score": "max"}).first()[0]
    assert none < 1e-6
    assert TX.score(docs.limit(0), {}, [0.0] * 10).count() == 0


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 1), (3, 1), (3, 2)])
def test_backoff_scores(spark, monkeypatch, data, order, least):
    monkeypatch.setattr(LM, "BLOCK_BYTES", 100_000)
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute.backoff(rows, order, least)
    got = LM.lm_scores(df, order, least).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, list(r.by_order)) == (want[r.doc_id][0], want[r.doc_id][2]) and abs(r.log_score - want[r.doc_id][1]) < 1e-5


def test_backoff_edge_cases(spark):
    rows = [(1, "a b a b a b"), (1, "a b a b a b"), (2, None), (3, ""), (None, "a"), (4, "b " * 5000), (5, "only here")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(2)
    got = LM.lm_scores(df).collect()
    want = brute.backoff([(i, t) for i, (_, t) in enumerate(rows)], 3)
    assert sorted(round(r.log_score, 4) for r in got) == sorted(round(x[1], 4) for x in want.values())
    assert all(r.mean_log_score is None for r in got if r.n_words == 0)
    assert LM.lm_scores(df.limit(0)).count() == 0
    alone = LM.lm_scores(df.where("doc_id = 5")).first()
    assert list(alone.by_order) == [2, 0, 0, 0]


@pytest.mark.parametrize("bits", [3, 8, 17, 18, 19, 24, 30])
def test_buckets_of_any_number_keep_whole_keys(bits):
    """As many buckets as petabytes need: the answers to a block's question are its own counts."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array([" ".join(random.Random(k).choice(["a", "b", "c", "dd"]) + str(j % 7) for j in range(300)) for k in range(5)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), texts], ["doc_id", "text"])
    (block,) = LM.blocks(iter([batch]), 3, bits, False)
    keys, counts, _, _ = block.table()
    (asked,) = LM._ask(iter([batch]), 3, bits)
    assert max(asked.column("bucket").to_pylist()) < 1 << bits
    answers = [LM.unpack(x) for a in LM._answer(iter([asked])) for x in a.column("sums").to_pylist()]
    assert (np.concatenate(answers) == counts).all() and len(np.unique(keys)) == len(keys)


def test_packed_numbers():
    import numpy as np

    rng = np.random.default_rng(0)
    for top in (0, 1, 255, 256, 1 << 40, (1 << 63) + 5):
        x = rng.integers(0, top + 1, 50, dtype=np.uint64)
        for even in (0, 3, 8):
            assert (LM.unpack(LM.pack(x, even)) == x).all()
    assert len(LM.unpack(LM.pack(np.zeros(0, np.uint64)))) == 0
