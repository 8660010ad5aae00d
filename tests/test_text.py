"""Folded texts against `unicodedata`, and which of them Python workers are sent."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest

from brindle.functions import text as T
from brindle.plans.registry import QUERIES
from tests.test_stages_brute import plain


def marked(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


FORMS = {
    "deobfuscate": (T.deobfuscate, plain),
    "email_folded": (T.email_folded, lambda t: "".join(T.EMAIL_HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKC", t))),
    "nfkc": (T.nfkc, lambda t: unicodedata.normalize("NFKC", t)),
    "strip_marks": (T.strip_marks, marked),
}
#: The languages of the tables, signs of typeset text, and letters of other scripts.
USUAL = ["Thé café, naïve!", "Größe ÄÖÜ ß", "¿Qué? ¡Añade 100 €!", "“it’s” – so", "Привет, мир", "日本語の", "call 555 😀", "plain", "", None]


def sent(df):
    """Bytes that Python workers are sent for the rows of a plan, and its rows."""
    rows, todo, total = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("pythonDataSent"):
            total += node.metrics().apply("pythonDataSent").value()
    return total, rows


@pytest.mark.parametrize("form", FORMS)
def test_every_character_alone_and_beside_others(spark, form):
    column, want = FORMS[form]
    dice, chars = random.Random(7), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    looked = [chr(c) for block in T.BLOCKS for c in block]
    texts = [*USUAL, *looked, *("".join(dice.choices(looked, k=40)) for _ in range(3000)), *("".join(dice.choices(dice.choice([looked[:1300], looked, chars]), k=4)) for _ in range(30000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r for r in df.select("t", column(df.t).alias("got")).collect() if r.got != (None if r.t is None else want(r.t))][:5] == []


@pytest.mark.parametrize("form", ["deobfuscate", "email_folded", "nfkc"])
def test_usual_texts_stay_out_of_python(spark, form):
    """Whole texts of four languages were sent, ten thousand at a time, and a worker held a batch of them in several forms."""
    column, want = FORMS[form]
    df = spark.createDataFrame([(t and t * 200,) for t in USUAL * 20], "t string").coalesce(1)
    total, rows = sent(df.select("t", column(df.t).alias("got")))
    assert [r.got for r in rows] == [None if r.t is None else want(r.t) for r in rows]
    # A row's place without a text is a few bytes.
    assert total < 40 * len(rows) + 2000


def test_texts_are_folded_a_few_at_a_time(monkeypatch):
    held = []
    monkeypatch.setattr(T.pa, "array", lambda values, kind, make=pa.array: (held.append(len(values)), make(values, kind))[1])
    got = T._by_text(T._nfkc).func(pa.chunked_array([["ﬁ", None] * 600]).combine_chunks())
    assert got.to_pylist() == ["fi", None] * 600 and max(held) <= T.ROWS


@pytest.mark.parametrize("kind", ["phone", "email", "url", "social", "intent", "obfuscation"])
def test_spans_are_found_once(spark, kind):
    """A filter of the same expression stood in front of every span query."""
    plan = QUERIES[f"{kind}_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("zip_with" in line for line in plan) == 1 and sum("ArrowEvalPython" in line for line in plan) == (kind == "email")
