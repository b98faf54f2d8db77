"""Chat formatting in budgeted windows (operator 11).

Conversations are rows of (conv_id, turn, role, text). Each is laid out in windows of at most ``budget``
tokens, for training on the assistant's turns:

- Prefix sums of the turns' tokens choose the windows. What a window's new turns may take is
  ``room`` = budget - history - tokens of the system turn (a quarter of the budget at least). A turn whose
  tokens lie within one cell [k room, (k + 1) room) of the prefix sums goes to that cell's window; one that
  crosses into another cell has a window of its own. So where a window begins depends on prefix sums alone,
  and a conversation of any length is cut by many tasks at once. A turn is never cut: one longer than the
  room stands alone and may exceed the budget.
- The system turn (a conversation's first turn, if its role is ``system``) is retained at the head of every window.
- The turns of the ``history`` tokens before a window are repeated there, whole turns only (none before a
  turn longer than the room).
- ``loss`` holds the spans [start, end) of code points of the formatted text on which a model is trained:
  the texts of new assistant turns. Repeated turns are masked, so each assistant text counts once.

A turn is written as ``### role: text</turn>`` and a line feed. Within texts and roles a backslash goes
after each backslash, after the ``<`` of ``</turn>`` and after each ``#`` that another one follows, in roles
after colons too; so no text can open or close a turn, and dropping the first of each backslash and the
character behind it gives the text back.

Tokens of a turn are its words (``tokens`` takes another Column of ``text``) and ``MARKS`` for its marks.

Null texts and roles are empty. Rows of null conv_id are one conversation. Turns of equal number follow
each other by role and MD5 of the text, nulls first; repeated rows are turns of their own. Other columns
don't matter and may have any name. No turns give no window. Running sums spread a conversation over
ranges; what meets in a task afterwards is one cell's turns, so no conversation is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import WORD
from stratalens.operators.ordered import running_sums

BUDGET, HISTORY, MARKS = 512, 128, 4

OPEN, CLOSE = "### ", "</turn>\n"


def escape(x: Column, role: bool = False) -> Column:
    return F.regexp_replace(x, r"(\\|<(?=/turn>)|#(?=#)" + ("|:)" if role else ")"), r"$1\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.?)", "$1")


def words_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def turn_rows(turns: DataFrame, tokens: Column | None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    n = words_of(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0))
    return rows.withColumn("key", F.md5(F.col("text").cast("binary"))).withColumn("n", (n + MARKS).cast("long"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """conv_id, window (rising along a conversation), n_repeated and n_new turns, n_tokens, formatted, loss (array of start, end)."""
    if not 0 <= history < budget:
        raise ValueError("history is less than the budget")
    rows = turn_rows(turns, tokens)
    first = F.min_by(F.struct("role", "text", "n"), F.struct("turn", "role", "key"))
    systems = rows.groupBy("conv_id").agg(first.alias("s")).where("s.role = 'system'").select(F.col("conv_id").alias("s_conv"), F.col("s.text").alias("s_text"), F.col("s.n").alias("s_n"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    rows = running_sums(rows, ["conv_id"], order, {"pos": F.lit(1), "upto": F.col("n")})
    rows = rows.join(systems, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").withColumn("is_system", (F.col("pos") == 1) & F.col("s_n").isNotNull())
    s_n = F.coalesce(F.col("s_n"), F.lit(0))
    rows = rows.withColumns({"room": F.greatest(F.lit(budget - history) - s_n, F.lit(max(1, budget // 4))), "size": F.when(F.col("is_system"), 0).otherwise(F.col("n")), "at": F.when(F.col("is_system"), 0).otherwise(F.col("upto") - F.col("n") - s_n)})
    rows = rows.withColumns({"cell": F.floor(F.col("at") / F.col("room")), "back": F.least(F.lit(history), F.col("room"))})
    rows = rows.withColumns({"alone": F.col("at") + F.col("size") > (F.col("cell") + 1) * F.col("room"), "head": F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(": ")), "body": escape(F.col("text"))})
    turn = F.struct("pos", "at", "size", "alone", "is_system", (F.col("role") == "assistant").alias("learn"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.length("head").alias("skip"), F.length("body").alias("chars"))
    near_end = ~F.col("is_system") & (F.col("at") + F.col("back") >= (F.col("cell") + 1) * F.col("room"))
    cells = F.when(near_end, F.array(F.struct("cell", F.lit(True).alias("new")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(False).alias("new")))).otherwise(F.array(F.struct("cell", F.lit(True).alias("new"))))
    each = rows.select("conv_id", "s_text", "s_n", "room", "back", turn.alias("t"), F.explode(cells).alias("c"))
    # A cell's turns: at most as many as its tokens and those before it allow.
    group = each.groupBy("conv_id", F.col("c.cell").alias("cell")).agg(
        *[F.first(x).alias(x) for x in ("s_text", "s_n", "room", "back")],
        F.sort_array(F.collect_list(F.when(F.col("c.new"), F.col("t")))).alias("new"),
        F.sort_array(F.collect_list(F.when(~F.col("c.new"), F.col("t")))).alias("old"),
    ).where(F.size("new") > 0)
    group = group.withColumns({"whole": F.filter("new", lambda t: ~t["alone"]), "alone": F.filter("new", lambda t: t["alone"])})
    fits = (F.size("alone") == 1) & (F.col("alone")[0]["size"] <= F.col("room"))

    def since(olds: Column, start: Column) -> Column:
        return F.filter(olds, lambda t: ~t["is_system"] & (t["at"] >= start - F.col("back")))

    none = F.filter("new", lambda t: F.lit(False))
    made = F.array(
        F.struct((2 * F.col("cell")).alias("window"), since(F.col("old"), F.get("whole", F.lit(0))["at"]).alias("repeated"), F.col("whole").alias("turns")),
        F.struct((2 * F.col("cell") + 1).alias("window"), F.when(fits, since(F.concat("old", "whole"), F.get("alone", F.lit(0))["at"])).otherwise(none).alias("repeated"), F.col("alone").alias("turns")),
    )
    out = group.select("conv_id", "s_text", "s_n", F.explode(F.filter(made, lambda w: F.size(w["turns"]) > 0)).alias("w")).select("conv_id", "s_text", "s_n", "w.*")
    keeps = F.col("s_n").isNotNull() & ~F.exists("turns", lambda t: t["is_system"])
    head = F.concat(F.lit(OPEN + "system: "), escape(F.col("s_text")), F.lit(CLOSE))
    part = lambda t, learn: F.struct(t["piece"].alias("piece"), t["skip"].alias("skip"), t["chars"].alias("chars"), learn.alias("learn"))
    parts = F.concat(F.transform("repeated", lambda t: part(t, F.lit(False))), F.transform("turns", lambda t: part(t, t["learn"])))
    spans = F.aggregate(
        "parts",
        F.struct(F.when(keeps, F.length(head)).otherwise(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct((acc["at"] + F.length(p["piece"])).alias("at"), F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["skip"]).alias("start"), (acc["at"] + p["skip"] + p["chars"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    tokens_in = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a + t["size"])
    return out.withColumn("parts", parts).select(
        "conv_id",
        "window",
        (F.size("repeated") + keeps.cast("int")).alias("n_repeated"),
        F.size("turns").alias("n_new"),
        (tokens_in("repeated") + tokens_in("turns") + F.coalesce("s_n", F.lit(0))).alias("n_tokens"),
        F.concat(F.when(keeps, head).otherwise(F.lit("")), F.array_join(F.col("parts.piece"), "")).alias("formatted"),
        spans.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: the new ones) and learnt (texts under the loss mask), parsed from what ``windows`` wrote."""
    parts = F.slice(F.split("formatted", CLOSE), F.col("n_repeated") + 1, F.col("n_new"))

    def parsed(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(OPEN) + 1))
        role = F.substring_index(inner, ": ", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(inner, F.length(role) + 3)).alias("text"))

    return formatted.select("conv_id", "window", F.transform(parts, parsed).alias("turns"), F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("learnt"), F.length("formatted").cast("long").alias("chars"))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and window; the digests run along them, so a conversation of any length takes no memory."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    open_, done = None, []

    def closed(c):
        return [c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for rows in it:
        for conv, n, said, learnt, chars in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "n", "said", "learnt", "chars")), strict=True):
            if open_ is None or open_[0] != conv:
                if open_ is not None:
                    done.append(closed(open_))
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_[1] += n
            open_[2].update(said.encode())
            open_[3] += len(learnt)
            open_[4].update(learnt.encode())
            open_[5] += chars
        if len(done) > 5000:
            yield batch(done)
            done = []
    if open_ is not None:
        done.append(closed(open_))
    if done:
        yield batch(done)


def digests(formatted: DataFrame) -> DataFrame:
    """For each conversation: turns and text under the loss mask as read back from its windows, as counts and SHA-256. A digest runs along its conversation, so that is one task's, in constant memory."""
    rows = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "window", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("learnt", "").alias("learnt"), "chars")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").drop("window").mapInArrow(_digests, _DIGESTS)
