"""Chat windows against a plain layout, and control strings that texts hold."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from stratalens.llm import chats

ROWS = "conv_id long, turn long, role string, text string"


def escaped(x: str, role: bool = False) -> str:
    out = ""
    for i, c in enumerate(x):
        out += c
        if c == "\\" or c == "<" and x.startswith("</turn>", i) or c == "#" and x[i + 1 : i + 2] == "#" or role and c == ":":
            out += "\\"
    return out


def plain(turns: list[tuple[str, str]], budget: int, history: int) -> list[tuple]:
    """(repeated, new, formatted, learnt texts) of one conversation's windows."""
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 4 for _, t in turns]
    system = turns[0][0] == "system"
    room = max(budget - history - (n[0] if system else 0), budget // 4)
    back = min(history, room)
    at, starts = 0, []
    for i in range(len(turns)):
        starts.append(at)
        at += 0 if system and i == 0 else n[i]
    groups: dict = {}
    for i, s in enumerate(starts):
        cell = s // room
        alone = s + (0 if system and i == 0 else n[i]) > (cell + 1) * room
        groups.setdefault((cell, alone), []).append(i)
    out = []
    for (_, alone), new in sorted(groups.items()):
        begin = starts[new[0]]
        old = [] if alone and n[new[0]] > room else [i for i in range(1 if system else 0, new[0]) if starts[i] >= begin - back]
        if system and 0 not in new:
            old = [0, *old]
        text, learnt = "", []
        for i in [*old, *new]:
            text += f"### {escaped(turns[i][0], True)}: "
            if i in new and turns[i][0] == "assistant":
                learnt.append((len(text), len(text) + len(escaped(turns[i][1]))))
            text += escaped(turns[i][1]) + "</turn>\n"
        out.append((len(old), len(new), text, learnt))
    return out


def laid_out(spark, convs: dict, **kw) -> dict:
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    got: dict = {}
    for w in chats.windows(spark.createDataFrame(rows, ROWS), **kw).orderBy("conv_id", "window").collect():
        got.setdefault(w.conv_id, []).append((w.n_repeated, w.n_new, w.formatted, [tuple(s) for s in w.loss]))
    return got


PARTS = ["###", "#", "</turn>", "</turn", "<", "\\", "\n", ": ", "a word", " ", "ü", "😀 ", "### assistant: ", "/turn>"]


def test_layout_and_reading_back(spark):
    rng = random.Random(11)
    convs = {}
    for c in range(60):
        roles = (["system"] if c % 3 == 0 else []) + [rng.choice(["user", "assistant", "system", "tool: x\\", "a:", ""]) for _ in range(rng.randint(0 if c % 3 == 0 else 1, 25))]
        convs[c] = [(r, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 60])))) for r in roles]
    kw = {"budget": 60, "history": 20}
    assert laid_out(spark, convs, **kw) == {c: plain(t, **kw) for c, t in convs.items()}
    rows = spark.createDataFrame([(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)], ROWS)
    back: dict = {}
    for w in chats.read_back(chats.windows(rows, **kw)).orderBy("conv_id", "window").collect():
        said, learnt = back.setdefault(w.conv_id, ([], []))
        said += [tuple(t) for t in w.turns]
        learnt += w.learnt
    assert back == {c: (turns, [t for r, t in turns if r == "assistant"]) for c, turns in convs.items()}
    for d in chats.digests(chats.windows(rows, **kw)).collect():
        turns = convs[d.conv_id]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert d.formatted_chars == sum(len(w[2]) for w in plain(turns, **kw))


def test_budget_holds_and_a_long_conversation_is_spread(spark):
    turns = [("system", "be kind"), *[("user" if i % 2 else "assistant", f"w{i} " * (i % 40)) for i in range(3000)]]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], ROWS)
    got = chats.windows(df, budget=200, history=50).orderBy("window").collect()
    assert max(w.n_tokens for w in got) <= 200 and sum(w.n_new for w in got) == 3001
    assert all(w.formatted.startswith("### system: be kind</turn>\n") and w.n_repeated <= 1 + 50 // 4 for w in got)
    assert sum(w.n_repeated > 1 for w in got) > len(got) // 2


def test_rows_with_nulls_ties_and_other_columns(spark):
    rows = [(None, 1, "user", None, 1), (None, None, None, "x", 1), (2, 0, "user", "b", 1), (2, 0, "user", "a", 1), (2, 0, "assistant", "z", 1), (2, 0, "user", "a", 1), (3, 0, "system", "", 0)]
    df = spark.createDataFrame(rows, ROWS + ", window int").withColumn("loss", F.lit(1))
    got = {r.conv_id: (r.n_repeated, r.n_new, r.formatted, [tuple(x) for x in r.loss]) for r in chats.windows(df).collect()}
    end = "</turn>\n"
    order = sorted("aab", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == {
        None: (0, 2, f"### : x{end}### user: {end}", []),
        2: (0, 4, f"### assistant: z{end}" + "".join(f"### user: {t}{end}" for t in order), [(15, 16)]),
        3: (0, 1, f"### system: {end}", []),
    }
    assert chats.digests(chats.windows(df.limit(0))).collect() == []


def test_tokens_may_be_counted_otherwise(spark):
    df = spark.createDataFrame([(1, i, "user", "abc") for i in range(6)], ROWS)
    assert [w.n_new for w in chats.windows(df, budget=14, history=0, tokens=F.length("text")).orderBy("window").collect()] == [2, 2, 2]
