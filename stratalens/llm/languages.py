"""Language ID by Bayesian evidence fusion (operator 8).

For a page of language l the evidence is: its text, by character n-gram likelihoods; the language its
markup declares; the suffix of its address and a language code in its path; and a prior from its host,
smoothed along host, parent domain, registered domain and all pages. The likelihoods of declarations
and suffixes and the priors come from grouped sums of text posteriors over all pages, each page's own
share taken out of its host's; none of them trusts a tag more than it has been right.

    log P(l | page) = text + log P(declared | l) + log P(suffix | l) + log P(code | l) + log prior(l | host)

The text model is learnt from labelled documents: of each language those with the least hashed ids,
about ``SAMPLE`` of them at most (the bound is a parameter), and of every language that has any.
N-grams of 1 to 3 bytes of lower-cased words are hashed to 2^16 cells. Text likelihoods are tempered,
as n-grams of a text depend on each other.

Hosts, with the sums of their parents, domains and suffixes, are a table of their own, which pages join
once: hosts that hold more than a thousandth of the pages (a thousand at most) by broadcast, the others
by a shuffle, so no task gets all pages of a large host. The tables of declarations and codes are
bounded by their letters (18,253 and 677 rows).

Pages are parsed in one forward pass, whatever they hold. Null or empty html or url: no evidence of that
kind. Pages without any text get tags and priors only. Of equally likely languages the first by name is
taken. No labelled documents: language null. Repeated rows give repeated results, a null page_id is
carried; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.shared import forget, join_hot, materialise, slices, text_column

SAMPLE, CELLS = 2_000, 1 << 16
#: Strength of each level's prior in pages, and the share of the text's log likelihood that counts, at most MOST nats between languages.
STRENGTH, TEMPER, MOST = 8.0, 0.25, 60.0

#: Elements that hold nothing to read, and classes of those that hold advertisements.
HIDDEN = ("script", "style", "noscript", "template", "nav", "aside", "footer")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in (*HIDDEN, "div")}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*+")
_ADVERT = re.compile(r"(?i)class=[\"']?(?:ads?|advert|banner)\b")
_LANG = re.compile(r"(?i)\b(?:xml:)?lang\s*+=\s*+[\"']?([a-z]{2,3})(?![a-z])")
_META = re.compile(r"(?i)content-language|og:locale")
_CONTENT = re.compile(r"(?i)content\s*+=\s*+[\"']?([a-z]{2,3})(?![a-z])")
_LONG_NUMBER = re.compile(r"&#[0-9]{4000,};?")
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")
_CODE = re.compile(r"/([a-z]{2})(?:[-_][A-Za-z]{2})?(?=/|$)")


def parse(source: str) -> tuple[str, str]:
    """(what a reader sees of a page, without scripts, navigation and advertisements; the language that its markup declares or '').

    Each search goes forward from where the last one ended, and one that finds nothing isn't tried again,
    so the time is in proportion to the page. A comment or hidden element without an end is a plain tag;
    a tag without an end is text.
    """
    out: list[str] = []
    html_lang = meta_lang = ""
    gone: set[str] = set()  # ends that don't come any more
    at = 0
    while (start := source.find("<", at)) >= 0:
        end = source.find(">", start)
        if end < 0:
            break
        out.append(source[at:start])
        at = end + 1
        if source.startswith("<!--", start):
            if "-->" not in gone:
                close = source.find("-->", start + 4)
                if close < 0:
                    gone.add("-->")
                else:
                    at = close + 3
            continue
        m = _NAME.match(source, start + 1, end)
        name = m[0].lower() if m and len(m[0]) <= 8 else ""
        if name == "html" and not html_lang:
            html_lang = m[1].lower() if (m := _LANG.search(source, start + 5, end)) else ""
        elif name == "meta" and not meta_lang:
            if (m := _META.search(source, start + 5, end)) and (m := _CONTENT.search(source, m.end(), end)):
                meta_lang = m[1].lower()
        if (name in HIDDEN or name == "div" and _ADVERT.search(source, start, end)) and name not in gone:
            close = _CLOSE[name].search(source, at)
            if close is None:
                gone.add(name)
            else:
                at = close.end()
    out.append(source[at:])
    text = " ".join(out)
    try:
        text = html_lib.unescape(text)
    except ValueError:  # a character number with thousands of digits
        text = html_lib.unescape(_LONG_NUMBER.sub("\ufffd", text))
    return text.strip(), html_lang or meta_lang


def address(url: str) -> tuple[str, str, str, str, str]:
    """(host, parent domain, registered domain, suffix, language code in the path) of an address; '' for what it lacks."""
    m = _URL.match(url.strip())
    host = m[1].lower().strip(".") if m else ""
    code = _CODE.search(m[2].lower()) if m else None
    labels = host.split(".") if host else []
    if not labels or re.fullmatch(r"[\d.]+|\[.*", host):
        return host, host, host, "", code[1] if code else ""
    return host, ".".join(labels[1:]) if len(labels) > 2 else host, ".".join(labels[-2:]), labels[-1], code[1] if code else ""


def cells(buf: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Cells of the 1-, 2- and 3-grams that end at each byte (3 x bytes); letters in lower case, everything below 'A' a space.

    No n-gram reaches over one of the ``starts`` of texts.
    """
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, np.where(buf < 65, 32, buf)).astype(np.uint32)
    one = low.copy()
    two, three = low.copy(), low.copy()
    last, last_but_one = low[:-1].copy(), low[:-2].copy()
    if starts is not None:
        last[starts[(starts > 0) & (starts < len(low))] - 1] = 0
        for back in (1, 2):
            at = starts - back
            last_but_one[at[(starts > 0) & (at >= 0) & (at < len(last_but_one))]] = 0
    two[1:] |= last << np.uint32(8)
    three[1:] |= last << np.uint32(8)
    three[2:] |= last_but_one << np.uint32(16)
    out = np.stack([one, two | np.uint32(1 << 24), three | np.uint32(2 << 24)])
    out *= np.uint32(0x9E3779B1)
    return (out >> np.uint32(16)).astype(np.int64)


class TextModel:
    """Log probability of each cell in each language."""

    def __init__(self, counts: np.ndarray, names: list[str]) -> None:
        self.names = names
        p = counts + 0.5
        self.table = np.log(p / p.sum(axis=0, keepdims=True)).astype(np.float32)

    def likelihoods(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts x languages) mean log likelihood of an n-gram times the text's length, tempered, the best language at 0."""
        n = len(off) - 1
        out = np.zeros((n, len(self.names)))
        some = np.flatnonzero(np.diff(off))
        if len(some):
            c = cells(buf, off[:-1][some])
            for k in range(len(self.names)):
                out[some, k] = np.add.reduceat(self.table[:, k][c].sum(axis=0, dtype=np.float64), off[:-1][some])
        out *= TEMPER / 3
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, -MOST)


def fit(docs: DataFrame, sample: int = SAMPLE) -> TextModel | None:
    """The text model of labelled documents (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("lang")).where("lang is not null and doc_id is not null")
    found = rows.groupBy("lang").count().collect()  # a row for each language
    if not found:
        return None
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).where("text is not null")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                buf = np.frombuffer(text.as_buffer() or b"", np.uint8)
                for at in range(0, len(buf), 1 << 20):
                    got = np.bincount(cells(buf[at : at + (1 << 20)]).ravel(), minlength=CELLS)
                    total[lang] = total[lang] + got if lang in total else got
        for lang, x in total.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(x[some], pa.int64())], ["lang", "cell", "n"])

    table = chosen.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows for each language
    names = sorted(set(table.column("lang").to_pylist()))
    if not names:
        return None
    counts, at = np.zeros((CELLS, len(names))), {x: i for i, x in enumerate(names)}
    counts[table.column("cell").to_numpy(), [at[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return TextModel(counts, names)


EVIDENCE = ("declared", "suffix", "code")
LEVELS = ("host", "parent", "domain")


def read_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, parent, domain, suffix, code, declared, n_bytes (of text) and text (log likelihoods) of each page."""
    names = ["page_id", *LEVELS, "suffix", "code", "declared", "n_bytes", "text"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sources = [x.as_py() or "" for x in part.column("html")]
                where = [address(x.as_py() or "") for x in part.column("url")]
                parsed = [parse(x) for x in sources]
                buf, off = text_column(pa.array([t for t, _ in parsed], pa.large_string()))
                like = np.concatenate([model.likelihoods(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)])
                host, parent, domain, suffix, code = ([w[k] for w in where] for k in range(5))
                cols = [part.column("page_id"), *(pa.array(x, pa.string()) for x in (host, parent, domain, suffix, code, [x for _, x in parsed])), pa.array(np.diff(off)), pa.array(like.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, host string, parent string, domain string, suffix string, code string, declared string, n_bytes long, text array<double>")


def _posterior(logs):
    """Normalised exponentials of an array column of logs."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def _given(of_kind, of_all, n_kinds: int):
    """Smoothed log probability of a tag in each language, from what pages with the tag and all pages sum to."""
    return F.zip_with(of_kind, of_all, lambda a, b: F.log((a + 1.0) / (b + n_kinds)))


def identify(pages: DataFrame, model: TextModel | None) -> DataFrame:
    """page_id, host, declared, suffix, text_language, language, confidence, posteriors (map) of each page."""
    shape = "page_id long, host string, declared string, suffix string, text_language string, language string, confidence double, posteriors map<string,double>"
    if model is None:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in shape.split(", ")[1:]])
    names, n = model.names, len(model.names)
    read = materialise(read_pages(pages, model).withColumn("share", _posterior(F.col("text"))), "pages")
    sums = [F.count("*").alias("n"), *[F.sum(F.col("share")[k]).alias(f"s{k}") for k in range(n)]]
    again = [F.sum(c).alias(c) for c in ("n", *[f"s{k}" for k in range(n)])]
    as_array = F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(n)])
    table = lambda t, c: t.select(c, as_array.alias(f"{c}_sums"))
    hosts = materialise(read.groupBy(*LEVELS, "suffix").agg(*sums), "hosts")  # a host has one parent, domain and suffix
    everything = hosts.agg(*again).first()
    n_pages = everything["n"] or 0
    full = hosts.select("host", "n", as_array.alias("host_sums"), "parent", "domain", "suffix")
    for c in ("parent", "domain", "suffix"):
        full = full.join(table(hosts.groupBy(c).agg(*again), c), c)
    full = materialise(full.select("host", "n", *[f"{c}_sums" for c in (*LEVELS, "suffix")]), "host-sums")
    out = join_hot(read, full, ["host"], "n", n_pages)
    tags = {c: read.groupBy(c).agg(*sums) for c in ("declared", "code")}
    for c, x in tags.items():
        out = out.join(F.broadcast(table(x, c)), c)  # codes of two or three letters
    kinds = {"suffix": hosts.select("suffix").distinct().count(), **{c: x.count() for c, x in tags.items()}}
    out = out.withColumn("all", F.array(*[F.lit(float(everything[f"s{k}"] or 0.0)) for k in range(n)]))

    def own(c):  # what other pages say
        return F.zip_with(c, "share", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    prior = F.transform(own(F.col("all")), lambda x: x + 1.0)
    prior = F.transform(prior, lambda x: x / total(prior))
    out = out.withColumn("prior", prior)
    for c in reversed(LEVELS):
        out = out.withColumn("_own", own(F.col(f"{c}_sums"))).withColumn("_n", total(F.col("_own")))
        out = out.withColumn("prior", F.when(F.col(c) == "", F.col("prior")).otherwise(F.zip_with("_own", "prior", lambda a, p: (a + STRENGTH * p) / (F.col("_n") + STRENGTH))))
    logs = F.zip_with("text", "prior", lambda t, p: t + F.log(p))
    for c in EVIDENCE:
        out = out.withColumn(f"_{c}", _given(own(F.col(f"{c}_sums")), own(F.col("all")), max(1, kinds[c] or 1)))
        logs = F.when(F.col(c) == "", logs).otherwise(F.zip_with(logs, f"_{c}", lambda x, y: x + y))
    out = out.withColumn("logs", logs).withColumn("p", _posterior(F.col("logs")))
    name_of = F.array(*map(F.lit, names))
    best = lambda a: name_of[(F.array_position(a, F.array_max(a)) - 1).cast("int")]
    return out.select(
        "page_id",
        "host",
        "declared",
        "suffix",
        F.when(F.col("n_bytes") > 0, best(F.col("text"))).alias("text_language"),
        best(F.col("p")).alias("language"),
        F.round(F.array_max("p"), 9).alias("confidence"),
        F.map_from_arrays(name_of, F.transform("p", lambda x: F.round(x, 9))).alias("posteriors"),
    )
