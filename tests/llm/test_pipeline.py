"""The five stages on a small table, each against what its operator's brute force gives."""

from __future__ import annotations

import corpus_pipeline as P
from stratalens.llm import toxicity
from stratalens.llm.shared import materialise
from tests.llm import brute


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    seen = {}
    for name, stage in P.STAGES:
        after = materialise(stage(spark, before, data), name)
        if name != P.STAGES[-1][0]:
            assert after.columns == docs.columns
        seen[name] = (before, after)
        before = after
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    a, b = seen["toxicity"]
    scores = {r.doc_id: r.predicted for r in toxicity.score(a, *toxicity.fit(a, spark.read.parquet(f"{data}/labels.parquet"))).collect()}
    assert pairs(b) == [x for x in pairs(a) if not scores[x[0]]]
    assert b.count() > 0.8 * a.count()

    a, b = seen["near_dedup"]
    least = brute.near(pairs(a), 5, 80)
    assert pairs(b) == [x for x in pairs(a) if least[x[0]][1] == x[0]]

    a, b = seen["substring_dedup"]
    import hashlib

    want, texts = brute.repeats(pairs(a)), dict(pairs(a))
    for i, t in pairs(b):
        assert hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == want[i][2]
        assert want[i][1] or t == texts[i]
    assert b.count() == a.count()

    a, b = seen["mixing"]
    words = lambda df: sum(len((r.text or "").encode().split()) for r in df.collect())
    assert abs(words(b) - 1.5 * words(a)) <= 20
    assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()}

    a, b = seen["sentencepiece"]
    assert pairs(b) == pairs(a) and b.where("not round_trip").count() == 0


def test_one_row_of_equal_ones_stays_whole(spark, data):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a, "x"), (5, a, "y"), (5, a, "x"), (None, b, "y"), (None, b, "x"), (None, "short", "x"), (6, None, "x"), (6, None, "x"), (None, None, "x")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string, source string")
    one = P.drop_near_duplicates(spark, docs, data)
    key = lambda df: sorted(map(str, df.collect()))
    want = [(5, a, "x"), (None, b, "x"), (None, "short", "x"), (6, None, "x"), (6, None, "x"), (None, None, "x")]
    assert key(one) == key(spark.createDataFrame(want, docs.schema))
    assert key(P.drop_repeats(spark, one, data)) == key(one)


def test_run_and_empty(spark, data):
    assert P.run(spark, data).count() > 0
    none = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        none = stage(spark, none, data)
        assert none.count() == 0
