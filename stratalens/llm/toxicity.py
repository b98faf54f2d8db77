"""Toxicity by a lexicon, misspellings and context (operator 9).

Lexicon: words, and stems (first 4 to 8 letters of longer words), that stand in more of the toxic than
of the other labelled texts, by a lower confidence bound of the log odds; of these a greedy cover picks
those that explain texts not yet explained (``COVER`` times). It is a trie. Terms within an edit
distance of 1 (from 5 letters) or 2 (from 9) are caught by Levenshtein automata intersected with the
trie: the states of the product, sets of (trie node, edits so far), are made as texts ask for them,
and most words leave the product after a few letters.

Context: in the ``SPAN`` words around a hit, quotation marks and words of reporting speak for
quotation; second-person words and exclamation for abuse. Hits, their log odds, edit distances and
contexts are the inputs of a logistic regression; labels, lang, source and doc_id never are.

Learning uses labelled rows outside the held-out fold (crc32 of doc_id as text, mod 3, is 1), at most
``SAMPLE`` = (4,000 toxic, 8,000 other) of them, those with the least hashed ids; the bound is a
parameter, and all terms of these rows are candidates. Of labelled rows that share a doc_id the text of
the least hash counts. Every document is scored on its whole text. Empty and null texts have no hits and get the
score of such texts. A null doc_id isn't held out. Without labels of both kinds the score is 0.
Repeated rows get equal scores; a repeated label counts once.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import Memo, doc_rows, forget, freed, materialise

SAMPLE = (4_000, 8_000)
COVER, SPAN, THRESHOLD = 3, 6, 0.7
STEMS = range(4, 9)
#: Bytes of a worker's memo of words, and moves of the product automaton that it keeps; both start anew when full.
MEMO_BYTES, MOVES = 32 << 20, 300_000
_WORD = re.compile(r"[^\W\d_]+")

# Cues of quotation and of address.
QUOTE_MARKS = "\"“”„«»‹›‘’'"
REPORTING = frozenset("said says wrote writes called quote quoted quotes reported reporting word words term slur insult insults sagte schrieb zitat wort dit écrit mot citation dijo escribió palabra cita".split())
ADDRESS = frozenset("you your yours yourself u du dich dir dein deine ihr tu te toi ton ta vous votre tú ti tus usted vosotros".split())


class FuzzyLexicon:
    """Trie of terms with the product automaton over it.

    ``terms`` maps a term to its weight; a term that ends in ``*`` is a stem and matches as the start of a longer word.
    """

    def __init__(self, terms: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget: list[int] = [0]
        self.weights = terms
        for term in sorted(terms):
            text = term.rstrip("*")
            n = len(text)
            edits = (0 if n < 6 else 1) if term.endswith("*") else 0 if n < 5 else 1 if n < 9 else 2
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            (self.stem if term.endswith("*") else self.word)[node] = term
        self.edits = {t: (0 if len(t) < 7 else 1) if t.endswith("*") else 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms}
        self._start_anew()

    def _start_anew(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[tuple[str, int] | None, tuple[str, int] | None]] = []
        self.made = 0
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # a letter of the term left out costs an edit and no letter of the word
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            best = lambda names: min(((e, names[n]) for n, e in key if names[n] is not None and e <= self.edits[names[n]]), default=None)
            word, stem = best(self.word), best(self.stem)
            self.accepts.append((word and word[::-1], stem and stem[::-1]))
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < nodes.get(node, 9):
                nodes[node] = e

        for node, e in self.states[state]:
            put(node, e + 1)  # a letter too many
            for c, child in self.children[node].items():
                put(child, e + (c != letter))
        found = self.moves[state][letter] = self._state(nodes)
        self.made += 1
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term, whole words before stems; None without one."""
        if self.made > MOVES:
            self._start_anew()
        state, stem = self.start, None
        moves, accepts, dead = self.moves, self.accepts, self.dead
        last = len(word) - 1
        for i, c in enumerate(word):
            nxt = moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if state == dead:
                return stem
            found = accepts[state][1]
            if found is not None and i < last and (stem is None or found[1] < stem[1]):
                stem = found
        word_found = accepts[state][0]
        return word_found if word_found is not None and (stem is None or word_found[1] <= stem[1]) else stem


FEATURES = ("hits", "distinct", "close", "far", "weight", "rate", "quoted", "address", "stems")


def context(words: list[str], spans: list[tuple[int, int]], text: str, at: int) -> tuple[bool, bool]:
    """(speaks for quotation, speaks for abuse) of the words around a hit."""
    lo, hi = max(0, at - SPAN), min(len(words), at + SPAN + 1)
    near = words[lo:at] + words[at + 1 : hi]
    before, after = text[max(0, spans[at][0] - 2) : spans[at][0]], text[spans[at][1] : spans[at][1] + 3]
    quoted = any(c in QUOTE_MARKS for c in before) and any(c in QUOTE_MARKS for c in after) or any(w in REPORTING for w in near)
    return quoted, any(w in ADDRESS for w in near) or "!" in after


class Scorer:
    """A lexicon and the regression over its hits."""

    def __init__(self, terms: dict[str, float], coefficients: list[float] | None = None) -> None:
        self.lexicon = FuzzyLexicon(terms)
        self.coefficients = coefficients
        self.memo = Memo(self.lexicon.match, MEMO_BYTES)

    def features(self, text: str) -> list[float]:
        low = text.lower()
        memo = self.memo
        hits = {w: found for w in set(_WORD.findall(low)) if (found := memo[w]) is not None}
        if not hits:
            return [0.0] * len(FEATURES)
        words, spans = [], []
        for m in _WORD.finditer(low):
            words.append(m[0])
            spans.append(m.span())
        at = [i for i, w in enumerate(words) if w in hits]
        found = [hits[words[i]] for i in at]
        contexts = [context(words, spans, low, i) for i in at]
        terms = {t for t, _ in found}
        weights = self.lexicon.weights
        return [
            math.log1p(len(at)),
            math.log1p(len(terms)),
            math.log1p(sum(e == 0 for _, e in found)),
            math.log1p(sum(e > 0 for _, e in found)),
            max(weights[t] / (1 + e) for t, e in found),
            math.log1p(100 * len(at) / len(words)),
            sum(q for q, _ in contexts) / len(at),
            sum(a for _, a in contexts) / len(at),
            math.log1p(sum(t.endswith("*") for t, _ in found)),
        ]

    def score(self, text: str) -> float:
        x = self.coefficients[0] + sum(c * f for c, f in zip(self.coefficients[1:], self.features(text), strict=True))
        return round(1 / (1 + math.exp(-max(-40.0, min(40.0, x)))), 9)


def _terms(text: str) -> set[str]:
    """Words of four letters or more and stems of a text."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 4}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression, by Newton steps."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (y - p)) - penalty * b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-10:
            break
    return b


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """(lexicon with log odds, coefficients) learnt from a bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    totals = dict(known.groupBy("toxic").count().collect())
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, sample[0]), (0, sample[1]))]
    ids = [(r.doc_id, r.toxic) for p in picked for r in p.collect()]  # at most sum(sample) rows
    if not totals.get(1) or not totals.get(0):
        return {}, [-40.0] + [0.0] * len(FEATURES)
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, "id long, toxic int"))
    rows = doc_rows(docs).join(chosen, F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    rows = materialise(rows.select("doc_id", "toxic", "x.text"), "labelled")  # at most sum(sample) rows

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in it:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[y].update(_terms(text or ""))
        terms = sorted(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "t", "n"])

    nt = sum(y == 1 for _, y in ids)
    nn = len(ids) - nt
    few = max(4, math.ceil(0.003 * nt))
    counts = rows.mapInArrow(lambda it: freed(count(it)), "term string, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("n") + 0.5) / (nn + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    best = counts.where(F.col("t") >= few).withColumn("odds", odds).withColumn("sure", sure).where("sure > 1.5").collect()  # terms of a bounded sample
    odds_of, sure_of = {r.term: r.odds for r in best}, {r.term: r.sure for r in best}
    terms = {t: odds_of[t] for t in _cover(rows, sure_of, few)}

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(terms)
        for batch in it:
            x = [s.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    found = sorted(rows.mapInArrow(lambda it: freed(measure(it)), "doc_id long, toxic int, x array<double>").collect())
    forget(rows)
    y = np.array([r.toxic for r in found], float)
    if not found or y.min() == y.max():
        return {}, [-40.0] + [0.0] * len(FEATURES)
    weight = np.where(y == 1, totals[1] / nt, totals[0] / nn)
    return terms, logistic(np.array([r.x for r in found]), y, weight / weight.mean()).tolist()


def _cover(rows: DataFrame, sure: dict[str, float], few: int) -> list[str]:
    """Candidate terms picked one by one for the sampled toxic texts that they explain, until each is explained often enough."""

    def which(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [sorted(t for t in _terms(text or "") if t in sure) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.string()))], ["doc_id", "x"])

    docs = {r.doc_id: set(r.x) for r in rows.where("toxic = 1").mapInArrow(lambda it: freed(which(it)), "doc_id long, x array<string>").collect()}
    holds: dict[str, set[int]] = {}
    for i, x in docs.items():
        for t in x:
            holds.setdefault(t, set()).add(i)
    left = dict.fromkeys(docs, COVER)
    names = sorted(holds)
    gain = lambda t: sum(left[i] for i in holds[t])
    rank = lambda t, g: (-g * sure[t], t.endswith("*"), -len(t), t)
    heap = [(*rank(t, g), g) for t in names if (g := gain(t)) >= few]
    heapq.heapify(heap)
    out: list[str] = []
    while heap:  # gains only fall, so a term whose gain hasn't changed is the best
        *_, best, g = heapq.heappop(heap)
        if best not in holds:
            continue
        now = gain(best)
        if now != g:
            if now >= few:
                heapq.heappush(heap, (*rank(best, now), now))
            continue
        out.append(best)
        covered = holds.pop(best)
        for i in covered:
            left[i] = max(0, left[i] - 1)
        text = best.rstrip("*")
        if best.endswith("*"):  # what a picked stem includes
            for t in names[bisect_left(names, text) : bisect_left(names, text + chr(0x10FFFF))]:
                holds.pop(t, None)
        for k in STEMS:  # stems that say no more than a picked term
            t = text[:k] + "*"
            if k <= len(text) and t in holds and len(holds[t] - covered) < few:
                del holds[t]
    return out


def score(docs: DataFrame, terms: dict[str, float], coefficients: list[float], threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; ``keep`` names further columns to carry, text among them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(terms, coefficients)
        for batch in it:
            x = np.array([s.score(t.as_py() or "") for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(x), pa.array((x >= threshold).astype(np.int32)), *(batch.column(c) for c in keep)], ["doc_id", "held_out", "score", "predicted", *keep])

    kinds = dict(docs.dtypes)
    extra = "".join(f", `{c}` {kinds[c]}" for c in keep)
    rows = doc_rows(docs, held_out(F.col("doc_id").cast("long")).alias("held_out"), *(c for c in keep if c != "text"))
    return rows.mapInArrow(lambda it: freed(run(it)), f"doc_id long, held_out boolean, score double, predicted int{extra}")
