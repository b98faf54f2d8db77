"""Operators 2, 4 and 5 against brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.llm import fingerprints as FP
from stratalens.llm import mixing as MX
from stratalens.llm import mpeg as MP

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def water(sizes: list[int], weights=(5.0, 2.0, 1.0), share=1.5, most=2.0) -> list[float]:
    """Sharing anew until none is above its cap."""
    w = [weights[i % 3] for i in range(len(sizes))]
    budget, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = budget - sum(target[i] for i in range(len(sizes)) if i not in open_)
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * w[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_reaches_each_target_exactly(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["src10", "src2", "Z", "é", "hot", None, "one", "empty"]
    rows = []
    for i in range(400):
        s = names[int(rng.integers(0, 7))] if rng.random() < 0.6 else "hot"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))) if rng.random() < 0.9 else None, s, "extra"))
    rows += [(1000, "", "empty", "extra"), (1001, None, "empty", "extra"), (None, "a b c", "one", "extra"), (7, "a b c", "one", "extra"), (7, "a b c", "one", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = MX.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall((t or "").encode()))
    order = sorted((x for x in sizes if x is not None)) + [None]
    want = dict(zip(order, water([sizes[x] for x in order]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = MX.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = MX.mixed_documents(df)
    assert mixed.columns == df.columns
    words = sum(len(WORD.findall(r.text.encode())) for r in mixed.collect())
    assert words == sum(taken.values())


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert MX.mix(df).count() == 0 and MX.mixed_documents(df).count() == 0


def shingles(text: str, k: int = 5) -> set:
    w = WORD.findall(text.encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_fingerprints(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one two"), (5004, " \n"), (5005, "é" * 7), (None, "first of all the rows by its id")]
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(*rows[i], 1) for i in rng.permutation(len(rows))], "doc_id long, text string, range int")
    got = {r.doc_id: r for r in FP.fingerprints_with_edits(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    assert len(got) == len(rows)
    gap = []
    for k, (i, _) in enumerate(order):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y, z = shingles(a), shingles(edited), shingles(b)
        for near, s in ((r.near_edited, y), (r.near_next, z)):
            true = len(x & s) / len(x | s) if x | s else 1.0
            gap.append(near - true)
            assert 0 <= near <= 1 and abs(near - true) < 0.25
        assert r.near_edited == pytest.approx(FP.likeness_of(r.fingerprint, r.edited_fingerprint))
    assert abs(np.mean(gap)) < 0.01  # bias corrected
    assert got[5002].fingerprint == got[5003].fingerprint and got[5000].fingerprint == got[5004].fingerprint == ""
    plain = {r.doc_id: r.fingerprint for r in FP.fingerprint(df).collect()}
    assert all(plain[i] == got[i].fingerprint for i in got)
    assert FP.fingerprints_with_edits(df.limit(0)).count() == 0


def test_rows_of_one_id_and_a_single_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l")], "doc_id long, text string")
    assert FP.fingerprints_with_edits(df).count() == 3
    one = FP.fingerprints_with_edits(df.where("text like 'g%'")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"g h i g h i").hexdigest()


def test_low_bits_pack():
    sig = np.arange(32, dtype=np.uint8).reshape(2, 16) & 15
    packed = FP.pack(sig, np.array([True, True]), 4)
    assert (FP.unpack(packed[1], 4) == sig[1]).all() and len(packed[0]) == 16


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_stream_round_trip(raw):
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    data = MP.write_stream(payload)
    m = MP.MpegAudio(data)
    assert m.payload() == payload and m.checked == m.sound == len(m.offsets) and m.skipped == 0
    assert m.table["frames"] == len(m.offsets) and m.table["bytes"] == len(data) - m.table["at"]
    assert m.samples == 1152 * len(m.offsets)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"TAG", b"ID3", b"ID3\x04\0\0\0\0\0\x09", b"Xing", b"Info", b"VBRI", b"\xff\xfb", b"\xff\xfb\x90\x64", MP._PREFIX[64], b"x", b"abcdefg", b"\0" * 61]), min_size=1, max_size=300), st.integers(0, 130))
def test_payload_that_looks_like_the_format_round_trips(parts, lead):
    raw = b"y" * lead + b"".join(parts)
    payload = raw.ljust(-(-len(raw) // 64) * 64, b"\0")
    m = MP.MpegAudio(MP.write_stream(payload))
    assert m.payload() == payload and m.skipped == 0 and m.checked == m.sound == len(m.offsets) == m.table["frames"]


def test_resynchronises_and_reports_damage():
    payload = bytes(range(200)) * 32
    data = bytearray(MP.write_stream(payload))
    m = MP.MpegAudio(bytes(data))
    n = len(m.offsets)
    junk = MP.MpegAudio(bytes(data[: m.offsets[2]]) + b"\xff\xfbnoise\xff\x00" * 3 + bytes(data[m.offsets[2] :]))
    assert len(junk.offsets) == n and junk.skipped == 27 and junk.payload() == payload
    data[m.offsets[1] + 10] ^= 1
    assert MP.MpegAudio(bytes(data)).sound == n - 1
    assert MP.MpegAudio(b"no audio here").feature().startswith("frames=0")
    assert MP.MpegAudio(b"").payload() == b""


def test_crc_and_headers():
    assert MP.crc16(b"123456789") == 0xAEE7  # CRC-16 with polynomial 0x8005, start 0xFFFF, not reflected
    h = MP.header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.layer, h.kbps, h.rate, h.size, h.samples) == (3, 128, 44100, 417, 1152)
    assert MP.header(b"\xff\xff\xff\xff") is None


def test_other_tags_and_tables():
    stream = MP.write_stream(b"x" * 64)
    body = b"\x03title"
    tag = b"ID3\x03\0\0" + bytes([0, 0, 0, len(body) + 10]) + b"TIT2" + struct.pack(">I", len(body)) + b"\0\0" + body
    m = MP.MpegAudio(tag + stream + b"TAG" + b"name".ljust(30, b"\0") + bytes(95))
    assert m.tags["TIT2"] == "title" and m.tags["title"] == "name" and m.payload() == b"x" * 64
    first = bytearray(192)
    first[:4] = MP._head(64, False)
    first[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 500, 1, 2, 1, 2, 1)
    m = MP.MpegAudio(bytes(first) + stream[stream.index(b"\xff\xfa") :])
    assert m.table["kind"] == "VBRI" and m.table["frames"] == 1 and m.table["bytes"] == 500


@pytest.mark.parametrize("size", [64, 320, 960, 1024, 1984])
def test_text_like_a_tag_is_payload(spark, size):
    """TAG at 128 bytes before the stream's end, wherever payload can stand there."""
    plain = MP.write_stream(b"x" * size)
    places = [k for k in range(size - 2) if MP.write_stream(b"x" * k + b"TAG" + b"x" * (size - k - 3))[-128:-125] == b"TAG"]
    assert bool(places) == (plain[-128:-125] == b"xxx")
    for k in places:
        text = "x" * k + "TAG" + "x" * (size - k - 3)
        r = MP.probe(MP.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
        assert r.payload_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.tail_crc32 == zlib.crc32(text.encode()[-64:])
        assert "skipped=0" in r.feature and "table=Xing:ok" in r.feature
        media = MP.write_stream(text.encode())
        real = MP.MpegAudio(media + b"TAG" + b"name".ljust(30, b"\0") + bytes(95))
        assert real.payload() == text.encode() and real.tags["title"] == "name" and real.skipped == 0
        cut = MP.MpegAudio(media[:-40] + b"TAG" + b"name".ljust(30, b"\0") + bytes(95))
        assert cut.tags["title"] == "name" and len(cut.offsets) == r.frames - 1


def test_media_of_a_table(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é" * 5000, "a" * 64, "TAG long " * 200_000]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in MP.probe(MP.store(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.crc_ok and r.sample_rate == 48000
    assert got[2].media_sha256 == got[5].media_sha256 and got[2].feature == got[5].feature
    assert MP.probe(MP.store(df.limit(0))).count() == 0
    none = MP.probe(MP.store(spark.createDataFrame([(None, None), (None, None), (None, "x")], "doc_id long, text string"))).collect()
    assert len(none) == 3 and len({r.feature for r in none if r.n_bytes == 0}) == 1 and all(r.doc_id is None for r in none)


@pytest.mark.parametrize("few", [20_000, 2])
def test_the_mix_meets_its_budgets_whatever_ids_repeat_or_are_null(spark, monkeypatch, few):
    monkeypatch.setattr(MX, "FEW_SOURCES", few)
    rng = random.Random(8)
    word = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(None, word(10), "one") for _ in range(300)] + [(None, "same words here", "two")] * 200 + [(7, word(5), "three") for _ in range(100)] + [(7, "x y z u v", "three")] * 50
    rows += [(i, word(rng.randint(0, 30)), rng.choice(["four", None])) for i in range(200)] + [(1, None, "one"), (None, "", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, key int").repartition(6)
    for share, most in ((1.5, 2.0), (0.37, 2.0), (0.011, 1.0))[: 3 if few > 2 else 1]:
        want = {r.source: round(r.target) for r in MX.mix(df, share=share, most=most).select("source", "target").distinct().collect()}
        mixed = MX.mixed_documents(df, share=share, most=most)
        got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(MX.n_words(F.col("text"))).alias("n")).collect()}
        assert {k: got.get(k, 0) for k in want} == want
        most_of = {r.key: r.n for r in mixed.groupBy("key").agg(F.sum(MX.n_words(F.col("text"))).alias("n")).collect()}
        assert all(n <= most * len((rows[k][1] or "").split()) for k, n in most_of.items())
        taken = {(r.doc_id, r.source, r.size): r.n for r in MX.mix(df, share=share, most=most).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("n")).collect()}
        sized = mixed.join(df.select("key", MX.n_words(F.col("text")).alias("size")), "key").groupBy("doc_id", "source", "size").agg(F.sum(MX.n_words(F.col("text"))).alias("n"))
        assert {(r.doc_id, r.source, r.size): r.n for r in sized.collect()} == taken
