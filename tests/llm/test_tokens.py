"""Operators 1 and 3 against the libraries whose results they must give."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from stratalens.llm import sentencepieces as SP
from stratalens.llm import token_counts as TC

PARTS = ["the", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "\x85", "'ll", "'s", "'", "l", "é", "日本", "<|endoftext|>", "<|end", "12", "!!", "foo", "Foo", "ing", "　", "̈", "a", "😀", "   x", "▁", "ꙮ", "\x01", "<s>", "<0x41>"]


@pytest.fixture(scope="module")
def counter():
    return TC.PrefixCounter(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10))
def test_every_prefix_counts_as_the_library_counts_it(counter, library, parts):
    text = "".join(parts)
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
    assert counter.prefix_counts(text) == want
    steps = counter.steps(text)
    stored = TC.stored_counts(TC.store(steps))
    assert steps.sum() == (want[-1] if want else 0) and stored.tolist() == want
    for budget in (0, 1, 3, 7):
        assert TC.longest_within(stored, budget) == max((k + 1 for k, x in enumerate(want) if x <= budget), default=0)


def test_compatibility_is_what_merging_gives(counter, spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(40).collect():
        counter.steps(r.text)
    pairs = random.Random(1).sample(sorted(counter._fits), 500)
    assert all(counter._fits[a, b] == (counter.merge(a + b) == [x for x in (a, b) if x]) for a, b in pairs)


def test_token_counts_of_a_table(spark, library):
    texts = [None, "", "a", "x " * 3000, "the <|endoftext|> end", "\n\n", "é" * 900]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)] + [(None, "a", "z", 1)] * 2, "doc_id long, text string, n_tokens string, n_bytes int")
    got = TC.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(got) == 9
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else "a") or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
        counts = TC.stored_counts(r.prefix_tokens)
        assert len(counts) == len(text) and (counts[-1] if text else 0) == n
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 512
    cuts = {"at_1": 1, "at_40": 40, "at_none": 0}
    asked = TC.fit(TC.tokens_at(TC.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")), cuts), {"fit_3": 3}).collect()
    for r in asked:
        text = (texts[r.doc_id] if r.doc_id is not None else "a") or ""
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert (r.at_1, r.at_40, r.at_none) == (n(text[:1]), n(text[:40]), 0)
        assert n(text[: r.fit_3]) <= 3
    assert TC.token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_other_kinds_of_files_are_refused():
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError, match="byte-level"):
            TC.PrefixCounter(json.dumps(spec | change))


def test_long_words_leave_no_trace(counter):
    before = counter._steps.size
    assert len(counter.steps("z" * 5000)) == 5000 and counter._steps.size == before


@pytest.fixture(scope="module")
def model():
    return SP.Unigram(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())


@pytest.fixture(scope="module")
def unigram(model):
    """The library with the same pieces and scores, as a Unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    for p, s in zip(m.pieces, model.scores, strict=True):
        p.score = s
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def exact(model, ids) -> float:
    """Score of a path, each piece in 64 bits; a run of bytes is one unknown character."""
    out, at = 0.0, 0
    while at < len(ids):
        if model.is_byte[ids[at]]:
            lead = model.byte_of[ids[at]]
            at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            out += model.unk_score
        else:
            out += model.scores[ids[at]]
            at += 1
    return out


def same_but_for_ties(model, unigram, text) -> bool:
    """Whether the ids are the library's. If not, its path is no better, and worse by no more than 32-bit sums along the text can hide."""
    got, other = model.encode(text).tolist(), unigram.encode(text)
    if got == other:
        return True
    ours, theirs = exact(model, got), exact(model, other)
    assert theirs <= ours + 1e-9 * abs(ours)
    assert ours - theirs <= 2 * max(len(got), len(other)) * float(np.finfo(np.float32).eps) * abs(ours)
    return False


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join))
@example("  theaaa")  # a tie that 32-bit sums settle otherwise
def test_unigram_viterbi_gives_the_best_path(model, unigram, text):
    same_but_for_ties(model, unigram, text)
    got = model.encode(text).tolist()
    assert model.decode(np.array(got, np.int32)) == unigram.decode(got)


def test_texts_of_a_table_have_the_library_s_pieces_but_for_ties(model, unigram, spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    other = sum(not same_but_for_ties(model, unigram, t or "") for t in texts)
    assert len(texts) == 1000 and other == 18


def test_ties_go_to_the_longest_last_piece(model):
    ids = model.encode("  theaaa").tolist()
    swapped = [*ids[:-2], ids[-1], ids[-2]]
    assert abs(exact(model, ids) - exact(model, swapped)) < 1e-12 and len(model.pieces[ids[-1]]) >= len(model.pieces[ids[-2]])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(model, text):
    text = text.encode("utf-8", "ignore").decode()
    if "▁" not in text:
        assert model.decode(model.encode(text)) == text


def test_path_is_the_best_of_all(model):
    """Brute force over every segmentation of short words."""
    index = {model.pieces[i]: i for i in model.ids}

    def best(w):
        if not w:
            return 0.0
        return max((model.scores[index[w[:k]]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index), default=-1e9)

    for w in ("▁anata", "▁erhing", "▁xyzzy", "▁of"):
        assert abs(model.score(model.path(w)) - best(w)) < 1e-9


WORDS = st.lists(st.one_of(st.text(max_size=12), st.lists(st.sampled_from([*PARTS, "▁"]), max_size=6).map("".join)), max_size=12).map(lambda ws: [w.encode("utf-8", "ignore").decode() for w in ws])


@settings(max_examples=300, deadline=None)
@given(WORDS)
@example(["", "▁", "▁ꙮꙮ\x01a", "ꙮ", "▁the", "▁the"])
def test_words_side_by_side_have_the_paths_of_single_words(model, words):
    assert [np.frombuffer(x, np.int32).tolist() for x in model.paths(words)] == [model.path(w) for w in words]


@pytest.mark.parametrize("run", [1, 40, 1 << 18])
def test_unknown_characters_without_byte_fallback_are_one(run, monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.byte_fallback = False
    plain = SP.Unigram(m.SerializeToString())
    words = ["▁ꙮꙮ\x01a", "ꙮ", "ꙮꙮ", "ꙮaꙮꙮ", "", "▁", "ꙮ"]
    monkeypatch.setattr(SP, "RUN_BYTES", run)
    got = [np.frombuffer(x, np.int32).tolist() for x in plain.paths(words)]
    assert got == [plain.path(w) for w in words] and got[1] == got[2] == [plain.unk]


def test_new_words_of_many_texts_are_not_searched_one_by_one(spark, data, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a\n▁b  c", "x" * 3000, "word " * 300 + "ꙮ" * 100]
    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    plain, many = SP.Unigram(raw), SP.Unigram(raw)
    want = [plain.encode(t).tolist() for t in texts]
    path, alone = many.path, []
    many.path = lambda word: alone.append(word) or path(word)
    monkeypatch.setattr(SP, "RUN_WORDS", 1000)
    many._memo.most = 100_000  # forgets between runs
    assert [x.tolist() for x in many.encode_all(texts)] == want
    assert all(len(w) > 64 for w in alone) and len(alone) < 10 < len(texts)


def test_double_array_trie():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zebra", b"zeb"]
    t = SP.DoubleArrayTrie(keys)
    for text in (b"abcd", b"b", b"zebras", b"\xff\x00\x01", b"q", b""):
        assert {(e, keys[k]) for e, k in t.prefixes(text)} == {(len(k), k) for k in keys if text.startswith(k)}


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  two  spaces ", "x"), (3, "  two  spaces ", "x"), (4, "word " * 20000, "x")], "doc_id long, text string, ids string")
    got = SP.digests(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == 5 and all(r.round_trip and len(r.ids) == r.n_pieces for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]
    both = SP.encode_decode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.decoded for r in both if r.doc_id == 3} == {"  two  spaces "}
