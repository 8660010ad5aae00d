"""Stages 1 and 2 and their combination against a plain scan in Python, over whole tables and made texts.

The plain forms are written from what the stages mean; they share the fixed values and the span scan
of ``test_detect_brute`` only.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from brindle.functions import patterns as P
from brindle.functions import text as T
from brindle.operators import detect
from brindle.plans.registry import QUERIES
from tests.test_detect_brute import MADE, SCANS, disjoint

SF = "/root/testdata/sf0.001"
KINDS = ("phone", "email", "url", "social", "intent")


def plain(text):
    """Zero-width, homoglyphs, fullwidth, marks, leet, NFKC, in that order."""
    text = "".join(c for c in text if c not in T.ZERO_WIDTH)
    text = "".join(T.HOMOGLYPHS.get(c, c) for c in text)
    text = "".join(chr(ord(c) - 0xFEE0) if ord(c) in T.FULLWIDTH else c for c in text)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFKC", "".join(T.LEET.get(c, c) for c in text))


def hashed(value):
    return hashlib.sha256(value.strip().lower().encode()).hexdigest()


def rules(text):
    """(score, labels, evidence, hashes) of stage 1."""
    clean, best, kept = plain(text), {}, []
    for t in [text] if clean == text else [text, clean]:
        for kind in KINDS:
            for off, n, conf, v in disjoint(SCANS[kind](t)):
                if conf > best.get((kind, off), -1.0):
                    best[kind, off] = conf
                    kept.append((kind, off, n, conf, v))
    hidden = bool(disjoint(SCANS["obfuscation"](text)))
    tops = {k: max(P.TYPE_WEIGHTS[k] * conf for kind, _, _, conf, _ in kept if kind == k) for k in {x[0] for x in kept}}
    contact = len(tops.keys() - {"intent"})
    score = min(1.0, max(tops.values()) + min(0.15, 0.08 * max(0, contact - 1)) + 0.12 * (hidden and contact > 0)) if tops else 0.0
    labels = ["obfuscation"] * hidden + list(dict.fromkeys(P.TYPE_LABELS[x[0]] for x in kept))
    evidence = [(off, n, P.TYPE_LABELS[kind], conf) for kind, off, n, conf, _ in kept]
    return score, labels, evidence, list(dict.fromkeys(hashed(v) for kind, _, _, _, v in kept if kind != "intent" and v))


def clusters(text):
    """Weight and matches of each cluster that a text shows: those of its first pattern that matches."""
    out = {}
    for name, (weight, group) in P.CLUSTERS.items():
        found = next((m for m in (list(re.finditer(p, text, re.IGNORECASE)) for p in group) if m), None)
        if found:
            out[name] = (weight, [(m.start(), len(m[0]), P.TYPE_LABELS["intent"], weight) for m in found])
    return out


def intents(text, before):
    """(score, labels, evidence) of stage 2; ``before`` are the last five texts of the thread."""
    shown = clusters(text)
    score = max((w for w, _ in shown.values()), default=0.0)
    score = min(1.0, score + 0.1) if len(shown) > 1 else score
    context = (0.0, 0.2, 0.4, 0.6)[min(3, sum(len(clusters(t)) for t in before))]
    labels = ["nlp_intent"] * (len(shown) > 0) + ["multi_intent_signals"] * (len(shown) > 1) + ["context_escalation"] * (context > 0.3)
    return min(1.0, score + 0.15 * context), labels, [e for _, each in shown.values() for e in each]


def spans(rows):
    return [(e["offset"], e["length"], e["type"], round(e["confidence"], 6)) for e in rows]


def rounded(rows):
    return [(o, n, t, round(c, 6)) for o, n, t, c in rows]


@pytest.fixture(scope="module")
def threads(spark):
    """Threads of made texts and of all documents and conversations, some texts null."""
    talk = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect():
        talk.setdefault(f"c{r.conv_id}", []).append((r.turn, r.text))
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    talk["made"] = list(enumerate([*MADE, None, "give me your number", "let's talk outside", "what's your email? text me on whatsapp", "fine"]))
    talk |= {f"d{i}": list(enumerate(docs[i : i + 8])) for i in range(0, len(docs), 8)}
    return [(thread, turn, t) for thread, texts in talk.items() for turn, t in sorted(texts, key=lambda x: x[0]) if t is None or len(t) <= detect.MAX_LENGTH]


def test_stages_equal_plain_forms(spark, threads):
    df = spark.createDataFrame(threads, "thread_id string, turn int, content string")
    got = {(r.thread_id, r.turn): r for r in detect.detect(df).collect()}
    before, wrong, seen = {}, [], set()
    for thread, turn, content in threads:
        text = content or ""
        s1, l1, e1, h1 = rules(text)
        s2, l2, e2 = intents(text, before.get(thread, []))
        before[thread] = [*before.get(thread, []), text][-5:]
        s1, s2, r = round(s1, 3), round(s2, 3), got[thread, turn]
        mean, most = (s1 * 0.5 + s2 * 0.3) / 0.8, max(s1, s2)
        risk = min(1.0, max(mean, most * 0.8) if most >= 0.85 else mean)
        seen |= {*l1, *l2}
        same = (
            r.stage1_score == pytest.approx(s1, abs=0.0011) and r.stage2_score == pytest.approx(s2, abs=0.0011) and r.risk_score == pytest.approx(risk, abs=0.002)
            and r.stage1_labels == l1 and r.stage2_labels == l2 and r.labels == list(dict.fromkeys(l1 + l2))
            and spans(r.evidence) == rounded(e1 + e2) and r.hashed_tokens == h1 and r.stage == (2 if s2 > 0 else 1)
        )
        if not same:
            wrong.append((text[:80], (s1, s2, risk, l1, l2, e1 + e2), (r.stage1_score, r.stage2_score, r.risk_score, r.stage1_labels, r.stage2_labels, spans(r.evidence))))
    assert len(got) == len(threads) and not wrong, (len(wrong), wrong[:3])
    assert seen == {*P.TYPE_LABELS.values(), "nlp_intent", "multi_intent_signals", "context_escalation"}


def test_token_hashes_and_clean_texts_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, hashed(m[0])) for d in docs for m in re.finditer(P.EMAIL["standard"], d.text or "", re.IGNORECASE)}
    assert {tuple(r) for r in QUERIES["token_hashes"](spark, SF).select("doc_id", "token_hash").collect()} == want and want
    clean = {d.doc_id: plain(d.text) for d in docs if d.text is not None}
    got = {r.doc_id: (r.n, r.clean_md5) for r in QUERIES["deobfuscated_text"](spark, SF).collect() if r.n is not None}
    assert got == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in clean.items()}


def test_versions_of_results(spark):
    rows = [("hello", 1, 1, False), ("x" * (detect.MAX_LENGTH + 1), 2, 1, False), ("boom", 3, 1, True)]
    df = spark.createDataFrame(rows, "content string, thread_id int, turn int, bad boolean")
    versions = lambda **kw: {r.thread_id: (r.ruleset_version, r.model_version) for r in detect.detect(df, failed=F.col("bad"), **kw).collect()}
    assert set(versions().values()) == {("1.0.0", None)}
    named = {"ruleset_version": "2.1", "ner": F.lit(0.5), "model_version": "entities-1"}
    assert versions(**named) == {1: ("2.1", "entities-1"), 2: ("2.1", None), 3: ("1.0.0", None)}
    assert versions(stages=(1,), **named)[1] == ("2.1", None)
    assert detect.detect(df, ner=F.lit(0.5)).filter("thread_id = 1").head().stage2_score == pytest.approx(0.3)
