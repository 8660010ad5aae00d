"""All six span detectors against a plain scan in Python, span by span, over whole documents and made texts.

The scan shares only the fixed values (patterns and word lists) with the library; offsets, lengths and
confidences are worked out from `re` and string methods.
"""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from brindle.functions import patterns as P
from brindle.functions import text as T
from brindle.operators import detect

MADE = [
    "Call me at 555-123-4567 or dial +44 20 7946 0958, tel: 0123456789", "5 5 5 1 2 3 4 5 6 7 and 5.5.5-1-2-3-4", "five five five, one two three four", "my number is one 2 three 4 five 6 seven ext 5",
    "+1 (222) 222-2222 x12 is not 555 1234", "٥٥٥-١٢٣-٤٥٦٧ in other digits", "mail user+tag@example.com, kate@x.io or a@b.zz", "user at example dot com; user [at] example [dot] org", "bob(at)site{dot}net me@host dot com x..y@z.com",
    "send me an email at jоhn@exаmple.com ｕｓｅｒ＠ｅｘａｍｐｌｅ．ｃｏｍ", "see https://example.com/a?b=c bit.ly/xyz www.t.me/abc x.y.com", "visit example dot com slash path, evil[.]com/(x) name ( dot ) org", "ftp://files.host.de click my link: user@site.com/x",
    "whatsapp me or add me on snap, my telegram is @cooluser", "DM me directly, slide into my dms off platform; right better @abc", "insta @ab discord.gg/abc name#1234 wa.me/+123 tiktok.com/@me", "find me on tik tok: @some_one, t.me/joinchat m.me/page",
    "what's your number? give me your phone. let's take this conversation offline! call me at noon", "don't give me your number; never ping me asap", "let's chat offline so we don't have to use this. just us, right now", "outside of here: whatsapp and telegram, reach me at once\n\nhmu",
    "ca​‍ll me ﻿", "pаypal Ωmega αβγ latinкир кирlatin greekαβ", "ｆｕｌｌ width", "ź̂algo é ́̂̃start", "h3110 w0rld 42 p@$$w0rd (x) a1b2c3 <<tag>>", "h e l l o there a b c", "x y z w next line", "😀 call 555-123-4567 😀 @someone insta", "",
]


def finds(p, text, flags=re.IGNORECASE):
    return list(re.finditer(p, text, flags))


def hit(terms, text):
    return any(t in text for t in terms)


def near(text, start, end, lower=True):
    part = text[max(0, start) : end]
    return part.lower() if lower else part


def matches_any(patterns, text):
    return any(re.search(p, text, re.IGNORECASE) for p in patterns)


def clamped(*amounts):
    return min(1.0, max(0.0, sum(amounts)))


def disjoint(spans):
    """Earliest first, then surest; a span that meets an accepted one goes."""
    out = []
    for s in sorted(spans, key=lambda s: (s[0], -s[2])):
        if all(s[0] >= o[0] + o[1] or s[0] + s[1] <= o[0] for o in out):
            out.append(s)
    return out


def span(m, conf):
    return (m.start(), len(m[0]), conf, m[0])


def phone(text):
    for kind, p in P.PHONE.items():
        for m in finds(p, text):
            digits = "".join(c for c in m[0] if c.isdecimal())
            words = [w.strip(".,!?;:-") for w in m[0].lower().split()]
            spoken = "".join(T.DIGIT_WORDS.get(w, w if w.isdigit() else "") for w in words)
            number = {"spelled": spoken, "mixed": spoken or digits}.get(kind, digits)
            if not 7 <= len(number) <= 15:
                continue
            n = len(digits)
            conf = clamped(
                0.5, 0.2 * (7 <= n <= 15), 0.2 * (kind in ("international", "us_format")), 0.15 * matches_any(P.PHONE_CONTEXT, near(text, m.start() - 30, m.start() + 30)),
                0.1 * m[0].strip().startswith("+"), -0.3 * (n > 15), -0.1 * (n == 10 and digits[0] in "01"), -0.25 * (n >= 7 and len(set(digits)) <= 3),
            )
            yield span(m, min(1.0, conf + 0.1) if kind == "spelled" else conf)


def last_label(name):
    return re.sub(r"[\[\]()]", "", re.sub(r"\s*dot\s*", ".", name)).split(".")[-1].strip()


def known_tld(tld):
    return tld in P.COMMON_TLDS or (len(tld) >= 2 and tld.isalpha())


def email(text):
    folded = "".join(T.EMAIL_HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKC", text))
    for kind, p in P.EMAIL.items():
        where = folded if kind == "standard" else text
        for m in finds(p, where):
            plain = m[0].lower()
            for word, sign in (("at", "@"), ("dot", ".")):
                plain = re.sub(rf"\s*[\[(]?\s*{word}\s*[\])]?\s*", sign, plain)
            plain = re.sub(r"\s+", "", plain)
            tld = last_label(plain)
            conf = clamped(
                0.5, 0.2 * known_tld(tld), 0.1 * (tld in P.COMMON_TLDS), 0.15 * (kind == "standard"), 0.1 * (kind in ("spaced", "bracket", "alt_separator")),
                0.15 * matches_any(P.EMAIL_CONTEXT, near(where, m.start() - 30, m.start() + 30)), -0.2 * ("@" not in plain or plain.index("@") < 2), -0.3 * hit(["..", "@@"], plain), -0.3 * hit(["/", "\\"], plain),
            )
            if conf > P.EMAIL_CUT[kind]:
                yield span(m, conf)


def host(address):
    return re.sub(r"(?i)^www\.", "", re.sub(r"(?i)^(?:https?|ftp)://", "", address)).split("/")[0].lower()


def url(text):
    for kind, p in P.URL.items():
        for m in finds(p, text):
            raw = host(m[0])
            if kind == "no_protocol" and not (known_tld(last_label(raw)) or raw.strip() in P.SHORTENERS + P.SOCIAL_DOMAINS):
                continue
            plain = m[0].lower()
            for word, sign in (("dot", "."), ("slash", "/")):
                plain = re.sub(rf"\s*[\[(]?\s*{word}\s*[\])]?\s*", sign, plain)
            domain = host(re.sub(r"\s*([./:])\s*", r"\1", plain))
            labels = domain.split(".")
            conf = clamped(
                0.5, 0.15 * known_tld(last_label(domain)), 0.25 * (domain.strip() in P.SHORTENERS), 0.25 * (domain.strip() in P.SOCIAL_DOMAINS), 0.15 * (kind == "full"), 0.15 * (kind in ("mention", "obfuscated", "bracket")),
                0.1 * matches_any(P.URL_CONTEXT, near(text, m.start() - 30, m.start() + 30)), -0.2 * (len(labels) > 1 and len(labels[-2]) < 2), -0.5 * ("@" in m[0]),
            )
            conf = min(1.0, conf + 0.1) if kind in ("shortener", "social") else conf
            if conf > P.URL_CUT[kind]:
                yield span(m, conf)


def social(text):
    for handles, mentions, indicators in P.PLATFORMS.values():
        for is_handle, p in [(True, p) for p in handles] + [(False, p) for p in mentions]:
            for m in finds(p, text):
                around = near(text, m.start() - 40, m.end() + 40)
                conf = clamped(
                    0.8 if is_handle else 0.7, 0.15 * hit([".me/", ".com/", ".gg/", ".org/"], m[0].lower()), 0.1 * ("@" in m[0]), 0.15 * hit(indicators, around),
                    0.1 * hit(P.OFF_PLATFORM, around), -0.2 * (is_handle and len(m[0].strip("@")) < 3),
                )
                if conf > (0.4 if is_handle else 0.5):
                    yield span(m, conf)
    for p in P.GENERIC_DM:
        for m in finds(p, text):
            around = near(text, m.start() - 50, m.end() + 50)
            yield span(m, 0.6 + 0.15 * any(hit(x[2], around) for x in P.PLATFORMS.values()) + 0.1 * hit(P.DM_OFF_PLATFORM, around))
    for m in finds(P.AT_MENTION, text):
        around = near(text, m.start() - 50, m.end() + 50)
        first = next((name for name, x in P.PLATFORMS.items() if hit(x[2], around)), None)
        if first:
            yield span(m, 0.8 if first in ("instagram", "telegram", "tiktok") else 0.65)


def intent(text):
    for boost, group in P.INTENT.values():
        for p in group:
            for m in finds(p, text):
                close, around = near(text, m.start() - 50, m.start() + 50), near(text, m.start() - 50, m.end() + 50)
                more = sum(b for b, terms in P.BOOSTERS.items() if re.search(r"\b(?:" + "|".join(terms) + r")\b", close, re.IGNORECASE))
                conf = clamped(
                    0.5, boost, min(0.3, more), -0.3 * bool(re.search(P.NEGATION, near(text, m.start() - 20, m.start()))), 0.1 * (sum(t in around for t in P.CONTACT_TERMS) >= 2), 0.15 * hit(P.EVASION_TERMS, around)
                )
                if conf > 0.4:
                    yield span(m, conf)
    at = 0
    for sentence in re.split(r"[.!?]\s+", text):
        kinds = sorted(k for k, (_, group) in P.INTENT.items() if matches_any(group, sentence))
        if len(kinds) > 1:
            yield (at, len(sentence), min(0.95, 0.6 + 0.15 * len(kinds)), "compound:" + ",".join(kinds))
        at += len(sentence) + 1


def runs(text, member):
    """(start, end) of the longest runs of characters for which ``member`` holds."""
    start = None
    for i, c in enumerate(text + "\0"):
        if i < len(text) and member(c):
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None


def obfuscation(text):
    for a, b in runs(text, lambda c: c in T.ZERO_WIDTH):
        yield (a, b - a, 0.95, text[a:b])
    for a, b in runs(text, lambda c: c in T.HOMOGLYPHS or c.isalnum() or c in "._-@"):
        glyph = next((i for i in range(a, b) if text[i] in T.HOMOGLYPHS), None)
        if glyph is not None:
            yield (glyph, b - glyph, 0.85, text[glyph:b])
    for low, high in (("Ѐ", "ӿ"), ("Ͱ", "Ͽ")):
        for m in finds(f"[a-zA-Z]+[{low}-{high}]+[a-zA-Z]*|[{low}-{high}]+[a-zA-Z]+", text, 0):
            yield span(m, 0.9)
    for a, b in runs(text, lambda c: "！" <= c <= "～"):
        yield (a, b - a, 0.8, text[a:b])
    for a, b in runs(text, lambda c: unicodedata.category(c)[0] == "M"):
        if b - a >= 2:
            a = max(0, a - 1)
            yield (a, b - a, 0.75, text[a:b])
    for m in finds(r"\b\w*[0-9@$!|()\[\]<>]{2,}\w*\b", text):
        ratio = sum(c in T.LEET for c in m[0]) / len(m[0])
        if ratio > 0.2:
            yield span(m, min(0.9, 0.5 + ratio / 2))
    for m in finds(r"\b(?:\w\s){3,}\w\b", text):
        if len(m[0].replace(" ", "")) >= 4:
            yield span(m, 0.7)


SCANS = {"phone": phone, "email": email, "url": url, "social": social, "intent": intent, "obfuscation": obfuscation}


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").distinct().collect()
    rows = [(i, t) for i, t in enumerate([*MADE, *sorted(r.text for r in docs if r.text)])]
    return rows, spark.createDataFrame(rows, "i int, content string")


@pytest.mark.parametrize("kind", SCANS)
def test_spans_equal_scan(texts, kind):
    rows, df = texts
    got = {r.i: [(s["off"], s["len"], round(s["conf"], 6), s["v"]) for s in r.s] for r in df.select("i", F.col("content")).transform(lambda d: detect.with_spans(d, kind)).select("i", F.col(f"{kind}_spans").alias("s")).collect()}
    wrong, found = [], 0
    for i, t in rows:
        want = [(o, n, round(c, 6), v) for o, n, c, v in disjoint(SCANS[kind](t))]
        found += len(want)
        if got[i] != want:
            wrong.append((t[:80], [x for x in got[i] if x not in want][:3], [x for x in want if x not in got[i]][:3]))
    assert found > 10 and not wrong, (found, len(wrong), wrong[:6])
