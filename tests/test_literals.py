from __future__ import annotations

import re

import pytest

from brindle.functions import literals
from brindle.functions import patterns as P

ALL = [*P.PHONE.values(), *P.EMAIL.values(), *P.URL.values(), *P.GENERIC_DM, P.AT_MENTION]
ALL += [p for handles, mentions, _ in P.PLATFORMS.values() for p in [*handles, *mentions]] + [p for groups in (P.INTENT, P.CLUSTERS) for _, group in groups.values() for p in group]


@pytest.mark.parametrize(("pattern", "want"), [
    (r"\b(?:telegram|tg)\s+me\b", {(" telegram ", " tg "), (" me ",)}),
    (r"\b(?:whats\s*app|wa)\s+me\b", {(" wa ", "whats"), (" me ",)}),
    (r"(?:a|b)?c+d{2}", {("c",), ("d",)}),
    (r"[xy]z|w", {("w", "xz", "yz")}),
    (r"\d+", set()),
])
def test_needed(pattern, want):
    assert set(literals.needed(pattern)) == want


def test_every_match_holds_what_is_needed(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect() if r.text]
    texts += ["text me on WA", "my Telegram is @abc_def", "KKiıing on Diſcord: give me your NUMBER aſap", "a (at) b [dot] com", "don't use this app", "let's chat off-platform, hit me up at wa.me/123", "snap me; dm me"]
    for text in texts:
        low = "".join(literals.ODD_CASE.get(c, c) for c in text).lower()
        words = " " + re.sub(r"\W+", " ", low) + " "
        for p in ALL:
            if re.search(p, text, re.I):
                assert all(any(x in (words if x[0] == x[-1] == " " else low) for x in part) for part in literals.needed(p)), (p, text)
