"""What searches for spans cost, and the texts on which they take another way."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from brindle.functions import patterns as P
from brindle.functions import text as T
from brindle.operators import detect
from brindle.operators import spans as S
from tests.test_detect_brute import MADE, SCANS, disjoint


def seconds(df):
    """Of the fastest of three runs."""
    took = []
    for _ in range(3):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return min(took)


def prose(spark, vocabulary, n=400, words=1500):
    dice = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(dice.choices(vocabulary, k=words))) for i in range(n)], "i int, content string").repartition(4).cache()
    df.count()
    return df


def test_plain_texts_meet_no_pattern_of_obfuscation(spark):
    """All eight patterns were searched for in every text; one of them alone takes about as long as all cheap tests."""
    df = prose(spark, "große über été où niño señal the rent of thing, and. here".split())
    glyphs = "".join(T.HOMOGLYPHS)
    one = seconds(df.select(F.expr(f"content RLIKE {S.pattern(rf'(?-i:[{glyphs}])')}")))
    all_of_them = seconds(detect.with_spans(df, "obfuscation").select("obfuscation_spans"))
    assert all_of_them < 2 * one, (all_of_them, one)


def test_homoglyphs_are_in_their_blocks(spark):
    df = spark.createDataFrame([(c,) for c in T.HOMOGLYPHS], "c string")
    assert df.filter(F.expr(f"NOT c RLIKE {S.quoted(detect.GLYPH_BLOCKS)}")).count() == 0


def test_texts_that_hold_the_border_sign(spark):
    texts = [f"{S.BORDER}{t}{S.BORDER} {t}" for t in MADE] + [S.BORDER, S.BORDER * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    for kind, scan in SCANS.items():
        got = {r.i: [(s["off"], s["len"], round(s["conf"], 6), s["v"]) for s in r.s] for r in detect.with_spans(df, kind).select("i", F.col(f"{kind}_spans").alias("s")).collect()}
        assert got == {i: [(o, n, round(c, 6), v) for o, n, c, v in disjoint(scan(t))] for i, t in enumerate(texts)}, kind


def test_plain_texts_meet_few_literals_of_intent(spark):
    """Every literal of 60 patterns was searched for in the whole text, so that a text was read some 150 times."""
    df = prose(spark, "große über was that you not share contact phone message the rent of thing, and.".split()).withColumn("l", F.lower("content")).cache()
    df.count()
    thrice = seconds(df.select(F.expr(" OR ".join(f"contains(l, 'no{i} such term')" for i in range(60)))))
    assert (took := seconds(detect.with_spans(df, "intent").select("intent_spans"))) < 3 * thrice, (took, thrice)
