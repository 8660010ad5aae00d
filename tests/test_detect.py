from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import patterns as P
from brindle.functions import text as T
from brindle.operators import detect, spans
from brindle.plans.registry import QUERIES

VECTORS = [
    ("phone", "Call me at 555-123-4567", True),
    ("phone", "(555) 123-4567", True),
    ("phone", "5 5 5 1 2 3 4 5 6 7", True),
    ("phone", "five five five one two three four", True),
    ("phone", "I have 42 items", False),
    ("email", "user+tag@example.com", True),
    ("email", "user at example dot com", True),
    ("email", "user [at] example [dot] com", True),
    ("email", "I went to the store at noon", False),
    ("url", "https://example.com/path", True),
    ("url", "visit example dot com", True),
    ("social", "whatsapp me", True),
    ("social", "my telegram is @cooluser", True),
    ("social", "DM me directly", True),
    ("intent", "let's take this conversation offline", True),
    ("intent", "The weather is nice today", False),
    ("obfuscation", "ca​ll me", True),
    ("obfuscation", "h e l l o there", True),
]


@pytest.mark.parametrize("kind", ["phone", "email", "url", "social", "intent", "obfuscation"])
def test_vectors(spark, kind):
    rows = [(i, text) for i, (k, text, _) in enumerate(VECTORS) if k == kind]
    df = spark.createDataFrame(rows, "i int, content string")
    for r in detect.with_spans(df, kind).collect():
        assert bool(r[f"{kind}_spans"]) == VECTORS[r.i][2], VECTORS[r.i]


def test_offsets_equal_finditer(spark):
    texts = ["a 😀 b@c.de, x.y@z.org!", "none", "q@w.er" * 3, "\nmulti\nuser@example.com\n"]
    p = P.EMAIL["standard"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", F.expr(spans.found("t", p)))
    for r in df.collect():
        assert [(m["off"], m["len"], m["v"]) for m in r.m] == [(x.start(), len(x[0]), x[0]) for x in re.finditer(p, r.t, re.IGNORECASE)]


def test_greedy_spans_are_disjoint(spark):
    rows = [[(5, 4, "a", 0.9, "x"), (0, 6, "a", 0.3, "y"), (9, 2, "a", 0.5, "z"), (0, 3, "a", 0.2, "w")]]
    df = spark.createDataFrame([(r,) for r in rows], f"s array<{spans.SPAN}>").withColumn("g", F.expr(spans.greedy("s")))
    assert [(m["off"], m["v"]) for m in df.head().g] == [(0, "y"), (9, "z")]


def test_deobfuscate(spark):
    df = spark.createDataFrame([("he​llo", "hello"), ("ｈｅｌｌｏ", "hello"), ("h3ll0", "hello"), ("аpple", "apple"), ("é", "e"), (None, None)], "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", T.deobfuscate(F.col("t"))).collect())


def test_scores(spark):
    df = spark.createDataFrame([("Call me at 555-123-4567", 1, 1), ("user@example.com", 2, 1), ("hello friend", 3, 1), (None, 4, 1)], "content string, thread_id int, turn int")
    got = {r.thread_id: r for r in detect.detect(df).collect()}
    assert got[1].stage1_score == pytest.approx(0.97) and "phone_number" in got[1].labels
    assert got[2].risk_score >= 0.4 and all(len(h) == 64 for h in got[2].hashed_tokens)
    assert got[3].risk_score == 0 and got[4].risk_score == 0 and got[3].stage == 1


def test_too_long_is_not_clean(spark):
    """Beyond the limit of a request there is no score and a label; at the limit all is read."""
    phone = "call 555-123-4567"
    rows = [(phone.rjust(n), n, 1) for n in (detect.MAX_LENGTH, detect.MAX_LENGTH + 1)]
    df = spark.createDataFrame(rows, "content string, thread_id int, turn int")
    got = {r.thread_id: r for r in detect.detect(df).collect()}
    at, above = got[detect.MAX_LENGTH], got[detect.MAX_LENGTH + 1]
    assert at.stage1_score > 0 and at.risk_score > 0 and "phone_number" in at.labels and "message_too_long" not in at.labels
    assert (above.stage1_score, above.risk_score, above.stage, above.evidence, above.hashed_tokens) == (None,) * 5
    assert above.stage1_labels == ["message_too_long"] and above.labels[0] == "message_too_long"


def test_span_queries_read_whole_texts(spark, tmp_path):
    texts = ["x" * 3 + " plain words" * 2_000 + t for t in (" call 555-123-4567 now", " mail user@example.com now", " https://example.com/path", " whatsapp me", " let's take this conversation offline", " ca\u200bll me")]
    columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(len(texts)).toPandas()
    columns["text"], columns["doc_id"] = texts, range(len(texts))
    spark.createDataFrame(columns).write.parquet(str(tmp_path / "documents.parquet"))
    for i, kind in enumerate(("phone", "email", "url", "social", "intent", "obfuscation")):
        assert i in {r.doc_id for r in QUERIES[f"{kind}_spans"](spark, str(tmp_path)).collect()}, kind


def test_combine(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).head()[0]
    s = {1: F.lit(0.97), 2: F.lit(0.75), 3: F.lit(0.0)}
    assert value(detect.combine(s)) == pytest.approx(0.776)
    assert value(detect.combine(s, (1,))) == pytest.approx(0.97)
    assert value(detect.combine(s, (9,))) == 0


def test_stages_and_failures(spark):
    """No stages mean all three, unknown ones score nothing, failed rows are results."""
    rows = [("give me your number, my phone is 555-123-4567", 1, 1, 0.5, ["burst_attempts"], 4), ("fine", 2, 1, 0.0, [], 0)]
    df = spark.createDataFrame(rows, "content string, thread_id int, turn int, stage3_score double, stage3_labels array<string>, n_thread int")
    got = {r.thread_id: r for r in detect.detect(df, stages=()).collect()}
    assert got[1].stage == 3 and "burst_attempts" in got[1].labels
    kinds = {(e["offset"], e["length"], round(e["confidence"], 3)) for e in got[1].evidence}
    assert {(0, len(rows[0][0]), 0.4), (0, 19, 0.8), (21, 11, 0.75)} <= kinds
    assert {(r.risk_score, r.stage) for r in detect.detect(df, stages=(9,)).collect()} == {(0.0, 1)}
    bad = {r.thread_id: r for r in detect.detect(df, failed=F.col("thread_id") == 2).collect()}
    assert (bad[2].risk_score, bad[2].stage, bad[2].labels, bad[2].evidence, bad[2].hashed_tokens) == (0.0, 0, ["analysis_error"], [], []) and bad[1].risk_score > 0


def test_values_equal_finditer(spark):
    """The queries of one pattern's values read whole texts, other scripts included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for name, p, column in (("phone_values", P.PHONE["us_format"], "phone"), ("url_values", P.URL["full"], "url")):
        want: dict[str, int] = {}
        for d in docs:
            for m in re.finditer(p, d.text or "", re.IGNORECASE):
                want[m[0]] = want.get(m[0], 0) + 1
        assert {r[column]: r.n for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == want
