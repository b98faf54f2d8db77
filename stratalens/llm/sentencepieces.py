"""SentencePiece encoding and decoding (operator 1).

Encoding is Unigram Viterbi: of all ways to write the normalised text as vocabulary pieces, the one
whose log scores sum highest. Pieces are found with a double-array trie over their UTF-8 bytes. A
character that no piece covers costs the lowest score less ten and is written as its UTF-8 bytes
(byte fallback). White space becomes the marker U+2581, one more is put in front, and decoding turns
markers back into spaces and drops the one in front.

No piece holds a marker behind another character, so the best path of a text is the best paths of
its marker-led words one after the other, and each worker keeps those of words it has met. Words new
to it are walked through the trie and scored by numpy, all those of a slice of texts side by side; words
of more than 64 characters one by one. If a vocabulary breaks this rule, whole texts are one word each and nothing else changes.

Scores are added in 64 bits, word by word, so the path is the best one but for rounding in the sixteenth
digit. Of paths of equal score the one whose last piece is longest wins, then the last but one, and so on
towards the front. The SentencePiece library adds in 32 bits along the whole text; where two paths are
nearer to each other than that rounding it may take the other one (its exact score is never better).

Vocabularies trained as BPE store merge ranks, not log scores. Their pieces get the log scores that
Zipf's law gives to ranks, -ln(rank + 1); Unigram vocabularies keep their own scores.

Nulls and empty texts: no ids, and '' decoded. Repeated rows give repeated results, a null doc_id is carried. A text that
holds U+2581 itself decodes with a space for it (round_trip false), as the library does.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalens.llm.shared import Memo, batches, doc_rows, freed, list_array

MARK = "▁"
MARKER = MARK.encode()
#: Bytes of a worker's memo of words; it starts anew when full, and long words are never kept.
MEMO_BYTES = 32 << 20
#: Words that are looked up in the memo at once, and bytes of new ones that are encoded side by side.
RUN_WORDS, RUN_BYTES = 1 << 16, 1 << 16
UNK_PENALTY = 10.0


class DoubleArrayTrie:
    """Static trie in two arrays: the child of s by byte b is t = base[s] + b + 1 if check[t] == s; value[s] is a key's number or -1."""

    def __init__(self, keys: list[bytes]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        words = [keys[i] for i in order]
        base, check, value = [0], [-1], [-1]
        free_from = 1
        used = [True]
        todo = [(0, 0, len(words), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo]) == depth:
                value[node] = order[lo]
                lo += 1
            children, i = [], lo
            while i < hi:
                b, j = words[i][depth], i
                while j < hi and words[j][depth] == b:
                    j += 1
                children.append((b, i, j))
                i = j
            if not children:
                continue
            first, span = children[0][0], children[-1][0]
            at = max(free_from - first - 1, 0)
            tries = 0
            while True:
                need = at + span + 2
                if need > len(used):
                    grow = need - len(used) + 256
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += [False] * grow
                if not any(used[at + b + 1] for b, _, _ in children):
                    break
                at += 1
                tries += 1
            if tries > 64:
                free_from = at + first + 1
            while free_from < len(used) and used[free_from]:
                free_from += 1
            base[node] = at
            for b, i, j in children:
                t = at + b + 1
                used[t], check[t] = True, node
                todo.append((t, i, j, depth + 1))
        self.base, self.check, self.value = base + [0] * 257, check + [-1] * 257, value + [-1] * 257

    def find(self, data: bytes) -> int:
        """The node of a string, 0 if no key goes on from it."""
        s = 0
        for b in data:
            t = self.base[s] + b + 1
            if self.check[t] != s:
                return 0
            s = t
        return s

    def prefixes(self, data: bytes, at: int = 0) -> list[tuple[int, int]]:
        """(end, key number) of every key that begins at ``at``."""
        out, s, base, check, value = [], 0, self.base, self.check, self.value
        for i in range(at, len(data)):
            t = base[s] + data[i] + 1
            if check[t] != s:
                break
            s = t
            if value[s] >= 0:
                out.append((i + 1, value[s]))
        return out


def read_model(raw: bytes) -> dict:
    """Pieces, scores and switches of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(raw)
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    return {
        "pieces": [p.piece for p in m.pieces],
        "scores": [p.score for p in m.pieces],
        "types": [p.type for p in m.pieces],
        "unigram": m.trainer_spec.model_type == 1,
        "byte_fallback": m.trainer_spec.byte_fallback,
        "dummy_prefix": m.normalizer_spec.add_dummy_prefix,
    }


def zipf_scores(scores: list[float], types: list[int]) -> list[float]:
    """Log scores of pieces whose stored scores only rank them; ties by id. Rounded to 32 bits, as model files store them."""
    out = list(scores)
    order = sorted((i for i, t in enumerate(types) if t == 1), key=lambda i: (-scores[i], i))
    for rank, i in enumerate(order):
        out[i] = float(np.float32(-math.log(rank + 2)))
    return out


class Unigram:
    """Encoder and decoder for one model file's content."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, raw: bytes) -> None:
        m = read_model(raw)
        self.pieces, self.types = m["pieces"], m["types"]
        self.scores = m["scores"] if m["unigram"] else zipf_scores(m["scores"], self.types)
        self.dummy_prefix = m["dummy_prefix"]
        normal = [i for i, t in enumerate(self.types) if t in (self.NORMAL, self.USER)]
        self.ids = normal
        self.trie = DoubleArrayTrie([self.pieces[i].encode() for i in normal])
        low, high = min(self.scores[i] for i in normal), max(self.scores[i] for i in normal)
        for i in normal:
            if self.types[i] == self.USER:
                self.scores[i] = len(self.pieces[i]) * high - 0.1
        self.unk_score = low - UNK_PENALTY
        self.score_of = [self.scores[i] for i in normal]
        self.marked = self.trie.find(MARKER)
        self.unk = self.types.index(self.UNKNOWN)
        byte_ids = [i for i, t in enumerate(self.types) if t == self.BYTE]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in byte_ids}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()} if m["byte_fallback"] else {}
        self.by_word = all(MARK not in p.lstrip(MARK) for p in (self.pieces[i] for i in normal))
        self.plain = [(" " * len(p) if p == MARK * len(p) else p.replace(MARK, " ")) for p in self.pieces]
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[byte_ids] = True
        self.silent = {i for i, t in enumerate(self.types) if t == self.CONTROL}
        self._base, self._check, self._value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self._score_of = np.array([*self.score_of, self.unk_score])  # the last key stands for a character that no piece covers
        self._id_of_key = np.array([*self.ids, self.unk], np.int32)
        self._id_of_byte = np.array([self.id_of_byte[b] for b in range(256)], np.int32) if self.id_of_byte else None
        self._memo = Memo(lambda word: array("i", self.path(word)).tobytes(), MEMO_BYTES)

    def path(self, word: str) -> list[int]:
        """Ids of the best path over one normalised word."""
        data = word.encode()
        n = len(data)
        best, back, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score_of
        i = 0
        while i < n:
            here, b = best[i], data[i]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single, s, j = False, 0, i
            if width == 3 and data[i : i + 3] == MARKER and self.marked:  # most words begin here; the way to the marker's node is known
                s, j = self.marked, i + 2
                e, k = i + 3, value[s]
                if k >= 0:
                    single, x = True, here + score[k]
                    if x > best[e]:
                        best[e], back[e], via[e] = x, i, k
                j += 1
            while j < n:
                t = base[s] + data[j] + 1
                j += 1
                if check[t] != s:
                    break
                s = t
                k = value[t]
                if k >= 0:
                    if j - i == width:
                        single = True
                    x = here + score[k]
                    if x > best[j]:
                        best[j], back[j], via[j] = x, i, k
            if not single:
                e, x = i + width, here + self.unk_score
                if x > best[e]:
                    best[e], back[e], via[e] = x, i, -2
            i += width
        out: list[int] = []
        while n:
            k, i = via[n], back[n]
            if k == -2:
                out += [self.id_of_byte[b] for b in reversed(data[i:n])] if self.id_of_byte else ([] if out and out[-1] == self.unk else [self.unk])
            else:
                out.append(self.ids[k])
            n = i
        return out[::-1]

    def paths(self, words: list[str]) -> Iterator[bytes]:
        """What ``path`` gives for each word, as bytes of 32-bit ids."""
        some, size = [], 0
        for word in words:
            some.append(word.encode())
            size += len(some[-1])
            if size >= RUN_BYTES:
                yield from self._side_by_side(some)
                some, size = [], 0
        if some:
            yield from self._side_by_side(some)

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        """``path`` of all words at once: the same sums in the same order, so the same ties.

        The words stand in one buffer, each with a byte behind it that is in no piece. A node of the search
        is a place in the buffer; an edge is a piece from one place to another of the same word.
        """
        buf = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(length + 1)])
        within = (np.arange(len(buf)) - np.repeat(first[:-1], length + 1)).astype(np.int32)
        width = (1 + (buf >= 0xC0) + (buf >= 0xE0) + (buf >= 0xF0)).astype(np.int32)
        begin = np.flatnonzero((buf & 0xC0 != 0x80) & (buf != 0xFF)).astype(np.int32)
        covered = np.zeros(len(buf), bool)
        edges, at, state, depth = [], begin, np.zeros(len(begin), np.int32), 0
        while len(at):
            child = self._base[state] + buf[at + depth] + np.int32(1)
            on = self._check[child] == state
            at, state, depth = at[on], child[on], depth + 1
            key = self._value[state]
            hit = key >= 0
            start = at[hit]
            edges.append((start, start + np.int32(depth), key[hit]))
            covered[start[width[start] == depth]] = True
        bare = begin[~covered[begin]]
        edges.append((bare, bare + width[bare], np.full(len(bare), len(self.ids), np.int32)))
        start, end, key = (np.concatenate(x) for x in zip(*edges, strict=True))
        place = within[start]
        order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
        start, end, key = start[order], end[order], key[order]
        best, via = np.full(len(buf), -math.inf), np.zeros(len(buf), np.int32)
        best[first[:-1]] = 0.0
        for lo, hi in pairwise(np.concatenate([[0], np.cumsum(np.bincount(place))])):  # edges from one place of a word end at different ones
            to = end[lo:hi]
            score = best[start[lo:hi]] + self._score_of[key[lo:hi]]
            better = np.flatnonzero(score > best[to])
            best[to[better]] = score[better]
            via[to[better]] = lo + better
        passed, node, origin = np.zeros(len(buf), bool), first[1:] - 1, first[:-1]
        while len(node):
            on = node > origin
            node, origin = node[on], origin[on]
            passed[node] = True
            node = start[via[node]]
        node = np.flatnonzero(passed)
        last = via[node]
        unknown = key[last] == len(self.ids)
        if self._id_of_byte is None:  # unknown characters in a row are one
            count = np.ones(len(node), np.int64)
            count[:-1][unknown[:-1] & unknown[1:] & (start[last[1:]] == node[:-1])] = 0
        else:
            count = np.where(unknown, end[last] - start[last], 1)
        ids = np.repeat(self._id_of_key[key[last]], count)
        upto = np.concatenate([[0], np.cumsum(count)])
        if self._id_of_byte is not None and unknown.any():
            which = np.flatnonzero(np.repeat(unknown, count))
            of = np.repeat(np.arange(len(node)), count)[which]
            ids[which] = self._id_of_byte[buf[start[last[of]] + which - upto[of]]]
        out = ids.tobytes()
        return [out[a:b] for a, b in pairwise((4 * upto[np.searchsorted(node, first)]).tolist())]

    def words(self, text: str) -> list[str]:
        """Normalised text cut in front of its runs of markers."""
        if not text:
            return []
        if self.by_word and self.dummy_prefix and MARK not in text and "  " not in text and text[0] != " ":
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        whole = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.by_word:
            return [whole]
        out, start = [], 0
        at = whole.find(MARK, 1)
        while at > 0:
            if whole[at - 1] != MARK:
                out.append(whole[start:at])
                start = at
            at = whole.find(MARK, at + 1)
        out.append(whole[start:])
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._memo.__getitem__, self.words(text))), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of each text."""
        split = [self.words(x) for x in texts]
        flat, found = list(chain.from_iterable(split)), []
        for at in range(0, len(flat), RUN_WORDS):
            run = flat[at : at + RUN_WORDS]
            self._memo.learn(run, self.paths)
            found += map(self._memo.__getitem__, run)
        off = np.cumsum([0, *map(len, split)]).tolist()
        return [np.frombuffer(b"".join(found[a:b]), np.int32) for a, b in pairwise(off)]

    def score(self, ids: list[int]) -> float:
        """Sum of log scores; each character written as bytes counts once, at its first byte."""
        return sum(self.unk_score * (self.byte_of[i] & 0xC0 != 0x80) if i in self.byte_of else self.scores[i] for i in ids)

    def decode(self, ids: np.ndarray) -> str:
        """Text of a list of ids; bytes that aren't UTF-8 become U+FFFD each."""
        if len(ids) and not self.is_byte[ids].any() and not self.silent:
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run = bytearray()
                if i not in self.silent:
                    out.append(self.plain[i])
            if run:
                out.append(_utf8(bytes(run)))
            text = "".join(out)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


_known: dict[int, Unigram] = {}


def model_of(key: int, raw: bytes) -> Unigram:
    """A worker's encoder of a model, made once."""
    if key not in _known:
        _known.clear()
        _known[key] = Unigram(raw)
    return _known[key]


def encode_decode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, decoded of each document; ``keep`` names further columns to carry, text among them.

    The model file is read once on the driver and broadcast; the file fixes its size.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        raw = f.read()
    shipped, key = spark.sparkContext.broadcast(raw), hash(raw)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(key, shipped.value)
        for part, _, _ in batches(it, "text"):
            ids = m.encode_all([x or "" for x in part.column("text").to_pylist()])
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            cols = [part.column("doc_id"), list_array(np.concatenate(ids), off, pa.int32()), pa.array([m.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(part.column(c) for c in keep)], ["doc_id", "ids", "decoded", *keep])

    rows = doc_rows(docs, *(c for c in keep if c != "text"))
    extra = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in keep)
    return rows.mapInArrow(lambda it: freed(run(it)), f"doc_id long, ids array<int>, decoded string{extra}")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The query's rows: ids with their number, how many are bytes, and what decoding them gives against the text."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        raw = f.read()
    shipped, key = spark.sparkContext.broadcast(raw), hash(raw)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(key, shipped.value)
        for part, _, _ in batches(it, "text"):
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids = m.encode_all(texts)
            decoded = [m.decode(x) for x in ids]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    list_array(np.concatenate(ids), off, pa.int32()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(m.is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    pa.array([a == b for a, b in zip(texts, decoded, strict=True)]),
                ],
                ["doc_id", "ids", "n_pieces", "n_byte_pieces", "decoded_sha256", "round_trip"],
            )

    return doc_rows(docs).mapInArrow(lambda it: freed(run(it)), "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, decoded_sha256 string, round_trip boolean")
