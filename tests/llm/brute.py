"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def repeats(rows: list[tuple], window: int = 20) -> dict:
    """doc_id: (words, removed, SHA-256 of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text: str | None, k: int) -> set:
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows: list[tuple], k: int, percent: int) -> dict:
    """doc_id: (size of the set, least doc_id reachable)."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holds = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for e in sets[i] for j in holds[e])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for e in sets[i]:
            holds[e].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def backoff(rows: list[tuple], order: int, least: int = 1, factor: float = 0.4) -> dict:
    """doc_id: (words, log score, words by order) by the counts of the other documents."""
    words = {i: (t or "").encode().split() for i, t in rows}
    grams = {i: Counter(tuple(w[k : k + o]) for o in range(1, order + 1) for k in range(len(w) - o + 1)) for i, w in words.items()}
    counts: Counter = sum(grams.values(), Counter())
    total = sum(map(len, words.values()))

    def score(i, k, o):
        w, n = words[i], lambda g: counts[g] - grams[i][g]
        o = min(o, k + 1)
        g = tuple(w[k - o + 1 : k + 1])
        if o == 1:
            return (n(g) or factor) / max(1, total - len(w)), int(n(g) > 0)
        if n(g) >= least:
            return n(g) / n(g[:-1]), o
        x, took = score(i, k, o - 1)
        return factor * x, took

    out = {}
    for i, w in words.items():
        got = [score(i, k, order) for k in range(len(w))]
        out[i] = (len(w), sum(math.log(x) for x, _ in got), [sum(t == o for _, t in got) for o in range(order + 1)])
    return out


def runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches of at least max(least, 2 period) words with that smallest period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list, found: list[tuple[int, int, int]]) -> list:
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]
