"""Exact token counts of every prefix of a text (operator 3).

For byte-level BPE the encodings of the prefixes of one pre-token form a tree: the encoding of a
prefix is that of a shorter prefix plus one token, and that last token is the only vocabulary entry
ending there that is *compatible* with the last token of the shorter prefix (two tokens are
compatible if their joined bytes encode to just these two). So one pass of dynamic programming over
a pre-token leaves the exact count at each of its prefixes. Texts are sums of pre-tokens; what each
character adds to the count is stored (a byte a character, compressed), and the count at any cut, the
longest prefix within a budget, and the total follow from it without encoding again.

Three places where a cut changes the pre-tokens are put right: a run of white space is one
pre-token as long as nothing follows, a cut contraction ("'l" of "'ll") is two, and a cut special
string is ordinary text.

Vocabulary files whose normaliser, pre-tokeniser, model or added tokens work otherwise are refused.
Nulls and empty texts: 0 tokens. A repeated row gives a repeated result. A null doc_id is carried; other
columns are not read. Memory of a worker's memos is bounded by bytes; long words are never kept.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import Memo, doc_rows

# The pre-token pattern of byte-level BPE vocabularies of this kind.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern; Python's own \s also holds \x1c to \x1f.
SPACE = r"[\t-\r \x85\xa0  -     　]"
#: Bytes of a worker's memo of words, and entries of that of token pairs; they start anew when full.
MEMO_BYTES, PAIRS = 64 << 20, 400_000
_CODEC = pa.Codec("zstd", 1)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at the prefixes of a text under one byte-level BPE vocabulary.

    ``vocabulary`` is the content of a tokenizer file (JSON) with a byte-level BPE model.
    """

    def __init__(self, vocabulary: str | bytes) -> None:
        spec = json.loads(vocabulary)
        _refuse_other_kinds(spec)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokens = {as_bytes(s) for s in spec["model"]["vocab"] if all(c in letters for c in s)} - {s.encode() for s in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.pretokens = regex.compile(PRETOKEN).findall
        self.runs = regex.compile(f"({SPACE}{{2,}})").split
        self.two_spaces = regex.compile(SPACE + "{2}").search
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self.made = {a + b: (a, b) for a, b in reversed(self.rank)}
        self._edges: tuple[dict, dict] = ({}, {})
        self._steps = Memo(lambda piece: b"".join([self._parts[p] for p in self.pretokens(piece)]), MEMO_BYTES)
        self._parts = Memo(self._pretoken_steps, MEMO_BYTES)

    def merge(self, data: bytes) -> list[bytes]:
        """BPE of a few bytes, straight from its definition; the tests compare the recurrence with it."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 30:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's left (0) or right (1) end while it is built, each with the rank of the merge that ends it."""
        known = self._edges[side]
        found = known.get(token)
        if found is None:
            found, x, until = [], token, 1 << 30
            while True:
                found.append((x, until))
                if x not in self.made:
                    break
                until = self.rank[self.made[x]]
                x = self.made[x][side]
            known[token] = found
        return found

    def _compatible(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens can stand side by side: no merge across their border comes before both sides are whole.

        Of two equal pairs the left one merges first, so a tie goes to the merge inside ``a``.
        """
        rank = self.rank
        ok = True
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                m = rank.get((x, y))
                if m is not None and m < x_until and m <= y_until:
                    ok = False
        if len(self._fits) > PAIRS:
            self._fits.clear()
        self._fits[a, b] = ok
        return ok

    def _single(self, a: bytes) -> bool:
        found = self._fits[b"", a] = self.merge(a) == [a]
        return found

    def pretoken_counts(self, data: bytes) -> list[int]:
        """Counts at every byte prefix of one pre-token (its bytes), the empty one first."""
        counts, last = [0], [b""]
        tokens, fits = self.tokens, self._fits
        for i in range(1, len(data) + 1):
            for j in range(i - 1, -1, -1):
                t = data[j:i]
                if t in tokens:
                    pair = (last[j], t)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = self._compatible(last[j], t) if j else self._single(t)
                    if ok:
                        counts.append(counts[j] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def at_chars(self, pretoken: str) -> list[int]:
        """Counts after each of a pre-token's characters."""
        data = pretoken.encode()
        by_byte = self.pretoken_counts(data)
        if len(data) == len(pretoken):
            out = by_byte[1:]
        else:
            ends = [i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
            out = [by_byte[i] for i in ends]
        if len(pretoken) == 3 and pretoken in ("'ll", "'ve", "'re"):
            out[1] = 2
        return out

    def unit(self, text: str) -> tuple[int, ...]:
        """Counts after each character of a piece of text that is cut where no pre-token spans."""
        out: list[int] = []
        base = 0
        for p in self.pretokens(text):
            at = self.at_chars(p)
            out += [base + x for x in at]
            base += at[-1]
        return tuple(out)

    def sections(self, text: str) -> Iterator[tuple[str, str]]:
        """(ordinary text, special string after it or '')."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text, ""
            return
        parts = self.split_special(text)
        for i in range(0, len(parts), 2):
            yield parts[i], parts[i + 1] if i + 1 < len(parts) else ""

    def pieces(self, section: str) -> Iterator[tuple[str, int]]:
        """(piece, length of the white-space run whose last character starts the next piece, or 0)."""
        parts = self.runs(section) if self.two_spaces(section) else [section]
        lead = ""
        for k in range(0, len(parts), 2):
            seg = lead + parts[k]
            if seg:
                bits = seg.split(" ")
                if bits[0]:
                    yield bits[0], 0
                for b in bits[1:]:
                    yield " " + b, 0
            if k + 1 < len(parts):
                run = parts[k + 1]
                if k + 2 < len(parts) and parts[k + 2]:
                    yield run[:-1], len(run)
                    lead = run[-1]
                else:
                    yield run, 0
                    lead = ""

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts after each character of a text, as encoding that prefix alone would give."""
        out: list[int] = []
        base = 0
        for section, special in self.sections(text):
            for whole in ([section + special[:-1], section] if special else [section]):
                at, run, here = base, 0, []
                for piece, spaces in self.pieces(whole):
                    counts = [at + x for x in self.unit(piece)]
                    if run:
                        counts[0] = run
                    run = at + self.at_chars(piece + whole[len(here) + len(piece)])[-1] if spaces else 0
                    here += counts
                    at += self.unit(piece)[-1]
                if special and whole is not section:
                    tail = here
                else:
                    if special:
                        here = tail + [at + 1]
                        at += 1
                    out += here
                    base = at
        return out

    def _pretoken_steps(self, pretoken: str) -> bytes:
        """What each character of a pre-token adds to the count, a signed byte each."""
        counts = self.at_chars(pretoken)
        return array("b", [y - x for x, y in zip((0, *counts), counts, strict=False)]).tobytes()

    def steps(self, text: str) -> np.ndarray:
        """What each character of a text adds to the count of its prefix; their sum is the text's own count."""
        try:
            if not self.two_spaces(text) and not any(s in text for s in self.special):
                head, *rest = text.split(" ")
                memo = self._steps
                return np.frombuffer((memo[head] if head else b"") + b"".join([memo[" " + x] for x in rest]), np.int8)
        except OverflowError:  # a character that changes the count by more than 127
            pass
        return np.diff(np.array(self.prefix_counts(text), np.int32), prepend=0)


def _refuse_other_kinds(spec: dict) -> None:
    """Raise for a tokenizer file that isn't a byte-level BPE of the kind that PRETOKEN describes."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    same = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not spec.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not same:
        raise ValueError("only byte-level BPE files with the usual pre-token pattern, without a normaliser, are supported")


_known: dict[int, PrefixCounter] = {}


def counter_of(key: int, vocabulary: bytes) -> PrefixCounter:
    """A worker's counter of a vocabulary, made once."""
    if key not in _known:
        _known.clear()
        _known[key] = PrefixCounter(vocabulary)
    return _known[key]


def store(steps: np.ndarray) -> bytes:
    """The steps of a text as it is stored: their width, their number, and they themselves compressed."""
    return struct.pack("<BI", steps.itemsize, len(steps)) + _CODEC.compress(steps.tobytes(), asbytes=True)


def stored_counts(raw: bytes) -> np.ndarray:
    """Token counts after each character, from what is stored."""
    width, n = struct.unpack_from("<BI", raw)
    return np.cumsum(np.frombuffer(_CODEC.decompress(raw[5:], width * n, asbytes=True), f"<i{width}"), dtype=np.int32)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix within a budget, from prefix counts (they may dip at white space)."""
    ok = np.flatnonzero(np.asarray(counts) <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix of at most ``limit`` tokens), prefix_tokens of each document.

    ``prefix_tokens`` is the stored table of counts at every prefix; ``tokens_at`` and ``fit`` answer from
    it. The vocabulary is read once on the driver and broadcast; its size is fixed by the file.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        raw = f.read()
    shipped, key = spark.sparkContext.broadcast(raw), hash(raw)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter_of(key, shipped.value)
        for batch in it:
            tokens, fits, prefixes = [], [], []
            for x in batch.column("text"):
                steps = c.steps(x.as_py() or "")
                n = int(steps.sum(dtype=np.int64))
                tokens.append(n)
                fits.append(len(steps) if n <= limit else longest_within(np.cumsum(steps, dtype=np.int32), limit))
                prefixes.append(store(steps))
            cols = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array(np.asarray(tokens, np.int64) > limit), pa.array(fits, pa.int64()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens"])

    rows = doc_rows(docs, F.coalesce(F.octet_length(F.col("text").cast("string")).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_tokens binary")


def tokens_at(table: DataFrame, cuts: dict[str, int]) -> DataFrame:
    """Stored tables with a column for each named cut: the tokens of the text's first so many characters (of the whole text if it is shorter)."""
    return _answers(table, list(cuts), lambda counts: [int(counts[min(k, len(counts)) - 1]) if k > 0 and len(counts) else 0 for k in cuts.values()])


def fit(table: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Stored tables with a column for each named budget: the characters of the longest prefix within it."""
    return _answers(table, list(budgets), lambda counts: [longest_within(counts, b) for b in budgets.values()])


def _answers(table: DataFrame, names: list[str], of) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [of(stored_counts(x.as_py())) for x in batch.column("prefix_tokens")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[i] for g in got], pa.int64()) for i in range(len(names)))], [*batch.schema.names, *names])

    return table.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in table.dtypes), *(f"`{n}` long" for n in names)]))
