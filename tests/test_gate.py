from __future__ import annotations

import pytest

from brindle.operators import gate

CASES = [
    ("Hello, how are you today?", "allow", 0.0, []),
    ("call 555-123-4567 please", "hard_block", 0.7225, ["contact_info_phone"]),
    ("write to user@example.com", "hard_block", 0.68, ["contact_info_email"]),
    ("see https://example.org/x", "nudge", 0.425, ["external_link"]),
    ("are you on telegram", "allow", 0.34, ["social_platform_mention"]),
    ("telegram  me", "nudge", 0.44, ["social_platform_mention", "obfuscation_detected"]),
    ("", "allow", 0.0, []),
    (None, "allow", 0.0, []),
    ("x" * 10_001, "hard_block", 1.0, ["message_too_long"]),
]


@pytest.fixture(scope="module")
def gated(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, content string")
    return {r.i: r for r in gate.gate(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_gate(gated, i):
    _, action, score, labels = CASES[i]
    row = gated[i]
    assert (row.action, row.labels) == (action, labels) and row.risk_score == pytest.approx(score)
    assert row.allowed == (action != "hard_block") and (row.block_reason is None) == row.allowed
    assert (row.nudge_message is None) == (action != "nudge")


def test_white_space_and_length_units(spark):
    """White space of other scripts separates like a blank; the limit counts UTF-16 units."""
    rows = [(0, "contact me at home"), (1, "﻿dm　me"), (2, "😀" * 5_000), (3, "😀" * 5_001), (4, "a" * 9_999 + "😀"), (5, "user at site dot com")]
    got = {r.i: r for r in gate.gate(spark.createDataFrame(rows, "i int, content string")).collect()}
    assert got[0].n_social == 1 and got[1].n_social == 1 and got[5].n_email == 1
    assert [got[i].action for i in (2, 3, 4)] == ["allow", "hard_block", "hard_block"]


def test_needs_lose_no_match(spark):
    """The cheap tests in front of the patterns change nothing."""
    from pyspark.sql import functions as F

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.substring("text", 1, 3000).alias("t"))
    texts = texts.union(spark.createDataFrame([("CALL 0044 20 7946 0958",), ("me AT site DOT com",), ("HTTPS://X.ORG WWW.A.COM Bit.Ly/a",), ("a(AT)b(DOT)c",), ("Text  ME, Contact Us On KIK",)], "t string"))
    for kind, patterns in gate.PATTERNS.items():
        for p, need in zip(patterns, gate.NEEDS[kind], strict=True):
            hit = F.col("t").rlike(gate.java_regex(p))
            assert texts.filter(hit & ~gate._may_match(F.col("t"), need)).isEmpty(), p


@pytest.mark.parametrize(
    ("content", "reason"),
    [
        ("call 555-123-4567 please", "Message blocked: detected phone number. Keep conversations on the platform for your safety."),
        ("on telegram, https://example.org/x, user@example.com or 555-123-4567", "Message blocked: detected phone number, email address, external link, social media reference. Keep conversations on the platform for your safety."),
        ("see https://example.org/x", "Message blocked: detected external link. Keep conversations on the platform for your safety."),
        ("x" * 10_001, "Message exceeds maximum length"),
        ("good morning", None),
        (None, None),
    ],
)
def test_block_reasons(spark, content, reason):
    """Kinds in their fixed order, whatever their order in the text; a lower edge blocks what is nudged by default."""
    row = gate.gate(spark.createDataFrame([(content,)], "content string"), hard_block=0.3, nudge=0.2).head()
    assert row.block_reason == reason and row.allowed == (reason is None)


def test_block_for_obfuscation_alone(spark):
    """What hides something and is no contact has the general reason."""
    plain = {f"n_{k}": 0 for k in gate.KINDS}
    texts = [t for t in ("t e l e", "c.a.l.l m.e", "five five five one two three four", "5 5 5 1 2 3 4", "h e r e", "n-u-m-b-e-r")]
    rows = gate.gate(spark.createDataFrame([(t,) for t in texts], "content string"), hard_block=0.01, nudge=0.005).collect()
    alone = [r for r in rows if r.n_obfuscation and not any(r[k] for k in plain if k != "n_obfuscation")]
    assert all(r.block_reason == gate.BLOCK_OTHER and r.labels == ["obfuscation_detected"] for r in alone) and alone
