"""Detection: six span detectors, stage scores and their combination, as one narrow plan per text.

Stage 1 looks at the text and, where it differs, at its deobfuscated form; stage 2 at intent clusters and
the messages before; stage 3 (``behavior``) at the user. Every detector is guarded by one cheap
test, so most texts never meet its patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import literals as L
from brindle.functions import patterns as P
from brindle.functions import text as T
from brindle.operators import behavior
from brindle.operators import spans as S
from brindle.session import spread

MAX_LENGTH, TOO_LONG = 10_000, "message_too_long"
#: Where all homoglyphs are.
GLYPH_BLOCKS = r"[\x{131}\x{237}\x{370}-\x{4FF}\x{1D400}-\x{1D7FF}]"


def _context(text: str, terms: list[str]) -> str:
    return f"{S.around(text, 'm.off - 30', 'm.off + 30')} RLIKE {S.pattern('|'.join(terms))}"


def _if(test: str, amount: float) -> str:
    return f"IF({test}, {amount}D, 0D)"


def _guard(text: str, test: str, parts: list[str]) -> str:
    return f"IF({text} RLIKE {S.pattern(test)}, {S.greedy(S.joined(parts))}, {S.NONE})"


def phone(text: str) -> str:
    digits = r"regexp_replace(m.v, '(?U)\\D', '')"
    words = ", ".join(f"'{k}', '{v}'" for k, v in T.DIGIT_WORDS.items())
    spelled = (
        rf"array_join(transform(split(trim(regexp_replace(lower(m.v), '(?U)\\s+', ' ')), ' '), w -> coalesce(try_element_at(map({words}), "
        rf"regexp_replace(w, '^[.,!?;:-]+|[.,!?;:-]+$', '')), IF(regexp_replace(w, '^[.,!?;:-]+|[.,!?;:-]+$', '') RLIKE '^(?U)\\d+$', regexp_replace(w, '^[.,!?;:-]+|[.,!?;:-]+$', ''), ''))), '')"
    )
    extracted, digits = digits, "m.d"
    distinct = f"size(array_distinct(filter(split({digits}, ''), c -> c <> '')))"
    parts = []
    for kind, p in P.PHONE.items():
        number = f"length({spelled if kind == 'spelled' else f'coalesce(nullif({spelled}, {chr(39)*2}), {digits})' if kind == 'mixed' else digits})"
        conf = " + ".join(
            [
                "0.5D",
                _if(f"length({digits}) BETWEEN 7 AND 15", 0.2),
                _if("true" if kind in ("international", "us_format") else "false", 0.2),
                _if(_context(text, P.PHONE_CONTEXT), 0.15),
                _if("startswith(trim(m.v), '+')", 0.1),
                _if(f"length({digits}) > 15", -0.3),
                _if(f"length({digits}) = 10 AND substr({digits}, 1, 1) IN ('0', '1')", -0.1),
                _if(f"length({digits}) >= 7 AND {distinct} <= 3", -0.25),
            ]
        )
        if kind == "spelled":
            conf = f"least(greatest({conf}, 0.0D), 1.0D) + 0.1D"
        parts.append(S.spans(text, p, "phone", conf, f"{number} BETWEEN 7 AND 15", d=extracted))
    return _guard(text, r"\d|\b(?:" + "|".join(T.DIGIT_WORDS) + r")\b", parts)


def email(text: str, folded: str) -> str:
    normal = r"regexp_replace(regexp_replace(regexp_replace(lower(m.v), '(?U)\\s*[\\[\\(]?\\s*at\\s*[\\]\\)]?\\s*', '@'), '(?U)\\s*[\\[\\(]?\\s*dot\\s*[\\]\\)]?\\s*', '.'), '(?U)\\s+', '')"
    named = {"n": normal}
    normal = "m.n"
    tld = rf"trim(element_at(split(regexp_replace(regexp_replace({normal}, '(?U)\\s*dot\\s*', '.'), '[\\[\\]\\(\\)]', ''), '[.]'), -1))"
    named["t"] = tld
    tld = "m.t"
    common = ", ".join(S.quoted(t) for t in P.COMMON_TLDS)
    parts = []
    for kind, p in P.EMAIL.items():
        where = folded if kind == "standard" else text
        conf = " + ".join(
            [
                "0.5D",
                f"(CASE WHEN {tld} IN ({common}) THEN 0.3D WHEN {tld} RLIKE '^\\\\p{{L}}{{2,}}$' THEN 0.2D ELSE 0D END)",
                _if("true" if kind == "standard" else "false", 0.15),
                _if("true" if kind in ("spaced", "bracket", "alt_separator") else "false", 0.1),
                _if(_context(where, P.EMAIL_CONTEXT), 0.15),
                _if(f"NOT contains({normal}, '@') OR length(substring_index({normal}, '@', 1)) < 2", -0.2),
                _if(f"contains({normal}, '..') OR contains({normal}, '@@')", -0.3),
                _if(rf"contains({normal}, '/') OR contains({normal}, '\\')", -0.3),
            ]
        )
        parts.append(S.spans(where, p, "email", conf, cut=P.EMAIL_CUT[kind], **named))
    return f"IF({S.any_of(S.low(text), ['@', 'at'])} OR contains({folded}, '@'), {S.greedy(S.joined(parts))}, {S.NONE})"


def url(text: str) -> str:
    no_scheme = lambda v: f"lower(split(regexp_replace(regexp_replace({v}, '(?i)^(?:https?|ftp)://', ''), '(?i)^www[.]', ''), '/')[0])"
    normal = r"regexp_replace(regexp_replace(regexp_replace(lower(m.v), '(?U)\\s*[\\[\\(]?\\s*dot\\s*[\\]\\)]?\\s*', '.'), '(?U)\\s*[\\[\\(]?\\s*slash\\s*[\\]\\)]?\\s*', '/'), '(?U)\\s*([./:])\\s*', '$1')"
    named = {"d": no_scheme(normal)}
    domain = "m.d"
    tld = lambda d: rf"trim(element_at(split(regexp_replace(regexp_replace({d}, '(?U)\\s*dot\\s*', '.'), '[\\[\\]\\(\\)]', ''), '[.]'), -1))"
    valid = lambda d: rf"{tld(d)} RLIKE '^\\p{{L}}{{2,}}$'"  # noqa: E731  every common TLD is two or more letters
    inside = lambda d, names: f"trim({d}) IN ({', '.join(map(S.quoted, names))})"
    short = f"size(split({domain}, '[.]')) >= 2 AND length(element_at(split({domain}, '[.]'), -2)) < 2"
    parts = []
    for kind, p in P.URL.items():
        conf = " + ".join(
            [
                "0.5D",
                _if(valid(domain), 0.15),
                _if(inside(domain, P.SHORTENERS), 0.25),
                _if(inside(domain, P.SOCIAL_DOMAINS), 0.25),
                _if("true" if kind == "full" else "false", 0.15),
                _if("true" if kind in ("obfuscated", "bracket", "mention") else "false", 0.15),
                _if(_context(text, P.URL_CONTEXT), 0.1),
                _if(short, -0.2),
                _if("contains(m.v, '@')", -0.5),
            ]
        )
        if kind in ("shortener", "social"):
            conf = f"least(greatest({conf}, 0.0D), 1.0D) + 0.1D"
        raw = "m.r"
        keep = f"{valid(raw)} OR {inside(raw, P.SHORTENERS)} OR {inside(raw, P.SOCIAL_DOMAINS)}" if kind == "no_protocol" else "true"
        parts.append(S.spans(text, p, "url", conf, keep, P.URL_CUT[kind], **named, r=no_scheme("m.v")))
    return f"IF({S.any_of(text, ['.', '://'])} OR contains({S.low(text)}, 'dot'), {S.greedy(S.joined(parts))}, {S.NONE})"


def social(text: str) -> str:
    near = lambda n: f"lower({S.around(text, f'm.off - {n}', f'm.off + m.len + {n}')})"
    names = lambda terms: f"array({', '.join(map(S.quoted, terms))})"
    all_indicators = [i for _, _, names in P.PLATFORMS.values() for i in names]
    rows = []  # (pattern, base, cut, letters around, link, sign, short, indicators, other terms)
    for handles, mentions, indicators in P.PLATFORMS.values():
        rows += [(p, "0.8D", "0.4D", 40, "0.15D", "0.1D", "-0.2D", names(indicators), names(P.OFF_PLATFORM)) for p in handles]
        rows += [(p, "0.7D", "0.5D", 40, "0.15D", "0.1D", "0D", names(indicators), names(P.OFF_PLATFORM)) for p in mentions]
    rows += [(p, "0.6D", "0.5D", 50, "0D", "0D", "0D", names(all_indicators), names(P.DM_OFF_PLATFORM)) for p in P.GENERIC_DM]
    patterns, *fields = zip(*rows, strict=True)
    table = S.table(list(patterns), **dict(zip(("base", "cut", "near", "link", "sign", "short", "known", "other"), fields, strict=True)))
    tests = {"y.link": "lower(m.v) RLIKE '[.](?:me|com|gg|org)/'", "y.sign": "contains(m.v, '@')", "0.15D": S.any_in("m.w", "y.known"), "0.1D": S.any_in("m.w", "y.other"), "y.short": "length(trim(BOTH '@' FROM m.v)) < 3"}
    conf = " + ".join(["y.base", *[f"IF({test}, {amount}, 0D)" for amount, test in tests.items()]])
    listed = S.each(S.candidates(text, table, list(patterns)), S.spans(text, None, "social", conf, cut="y.cut", w=near("y.near")))
    first = "CASE " + " ".join(f"WHEN {S.any_of("m.w", names)} THEN '{name}'" for name, (_, _, names) in P.PLATFORMS.items()) + " END"
    conf = f"0.65D + {_if(f'{first} IN ({chr(39)}instagram{chr(39)}, {chr(39)}telegram{chr(39)}, {chr(39)}tiktok{chr(39)})', 0.15)}"
    mention = S.spans(text, P.AT_MENTION, "social", conf, f"{first} IS NOT NULL", w=near(50))
    return S.greedy(S.joined([listed, mention]))


def intent(text: str) -> str:
    window, near = f"lower({S.around(text, 'm.off - 50', 'm.off + m.len + 50')})", "m.w"
    boost = " + ".join(_if(f"m.c RLIKE {S.pattern(chr(92) + 'b(?:' + '|'.join(terms) + ')' + chr(92) + 'b')}", b) for b, terms in P.BOOSTERS.items())
    count = " + ".join(f"CAST(contains({near}, '{t}') AS int)" for t in P.CONTACT_TERMS)
    patterns = [p for _, group in P.INTENT.values() for p in group]
    table = S.table(patterns, base=[f"{0.5 + base}D" for base, group in P.INTENT.values() for _ in group])
    conf = f"y.base + least(0.3D, {boost}) + {_if(f'{S.around(text, chr(109) + ".off - 20", "m.off")} RLIKE {S.pattern(P.NEGATION)}', -0.3)} + {_if(f'({count}) >= 2', 0.1)} + {_if(S.any_of(near, P.EVASION_TERMS), 0.15)}"
    listed = S.each("rows", S.spans(text, None, "intent", conf, cut=0.4, w=window, c=S.around(text, "m.off - 50", "m.off + 50")))
    # Written out, because a pattern that is no literal is compiled for every sentence.
    kinds = ", ".join(f"IF(q RLIKE {S.pattern('|'.join(group))}, '{name}', NULL)" for name, (_, group) in P.INTENT.items())
    compound = (
        f"filter(aggregate(split({text}, '(?U)[.!?]\\\\s+'), named_struct('p', 0, 'o', {S.NONE}), (s, q) -> named_struct('p', s.p + length(q) + 1, 'o', concat(s.o, transform(array(array_compact(array({kinds}))), "
        "k -> named_struct('off', s.p, 'len', length(q), 'type', 'intent', 'conf', IF(size(k) >= 2, least(0.95D, 0.6D + size(k) * 0.15D), 0D), 'v', concat('compound:', array_join(sort_array(k), ',')))))), s -> s.o), m -> m.conf > 0)"
    )
    # No sentence matches two groups where the text matches no pattern.
    rows = f"filter({S.candidates(text, table, patterns)}, y -> {text} RLIKE y.test)"
    return f"element_at(transform(array({rows}), rows -> IF(size(rows) > 0, {S.greedy(S.joined([listed, compound]))}, {S.NONE})), 1)"


def obfuscation(text: str) -> str:
    glyphs = "".join(T.HOMOGLYPHS)
    leet = "".join("\\" + c if not c.isalnum() else c for c in T.LEET)
    # The class of leet characters escapes its brackets: Java reads an open one as a nested class.
    ratio = rf"(length(m.v) - length(regexp_replace(m.v, {S.quoted('[' + leet + ']')}, ''))) / CAST(length(m.v) AS double)"
    marks = r"\p{M}"
    # A search for one plain class is many times faster than the patterns, and most texts hold none of its characters.
    having = lambda chars, *rest: f"IF({text} RLIKE {S.quoted(chars)}, {S.spans(text, rest[0], 'obfuscation', *rest[1:])}, {S.NONE})"
    wide = [
        having(r"[\x{200B}-\x{206F}\x{FEFF}]", f"[{T.ZERO_WIDTH}]+", "0.95D"),
        # Case matters for homoglyphs, unlike elsewhere.
        having(GLYPH_BLOCKS, rf"(?-i:[{glyphs}](?:[{glyphs}]|[\p{{L}}\p{{N}}._\-@])*)", "0.85D"),
        having("[Ѐ-ӿ]", r"(?-iu:[a-zA-Z]+[Ѐ-ӿ]+[a-zA-Z]*|[Ѐ-ӿ]+[a-zA-Z]+)", "0.90D"),
        having("[Ͱ-Ͽ]", r"(?-iu:[a-zA-Z]+[Ͱ-Ͽ]+[a-zA-Z]*|[Ͱ-Ͽ]+[a-zA-Z]+)", "0.90D"),
        having("[！-～]", r"[！-～]+", "0.80D"),
        having(rf"{marks}{{2}}", rf"(?:(?s:.)|^){marks}{{2,}}", "0.75D"),
    ]
    any_sign = r"\x{80}-\x{10FFFF}"
    parts = [
        f"IF({text} RLIKE {S.quoted(r'[^\x00-\xFF]')}, {S.joined(wide)}, {S.NONE})",
        having(r"[0-9@$!|()\[\]<>]{2}", r"\b\w*[0-9@$!|()\[\]<>]{2,}\w*\b", f"least(0.9D, 0.5D + {ratio} * 0.5D)", f"{ratio} > 0.2D"),
        having(rf"(?:[\w{any_sign}][\s{any_sign}]){{3}}[\w{any_sign}]", r"\b(?:\w\s){3,}\w\b", "0.70D", "length(replace(m.v, ' ', '')) >= 4"),
    ]
    return S.greedy(S.joined(parts))


DETECTORS = {"phone": phone, "url": url, "social": social, "intent": intent, "obfuscation": obfuscation}


def with_spans(messages: DataFrame, kind: str, content: str = "content") -> DataFrame:
    """Adds ``<kind>_spans`` found in one column."""
    body = email("x.t", "x.f") if kind == "email" else DETECTORS[kind]("x.t")
    text, none = F.col(content), F.lit(None).cast("string")
    forms = {"f": lambda: T.email_folded(text), "l": lambda: L.folded(text), "w": lambda: L.words_of(L.folded(text))}
    # The forms are the variable of a lambda, so they are made once for all patterns, and only those that the detector looks at.
    form = F.struct(text.alias("t"), *[(make() if f"x.{k}" in body else none).alias(k) for k, make in forms.items()])
    m = spread(messages).withColumn("_d_form", F.array(form))
    return m.withColumn(f"{kind}_spans", F.expr(f"element_at(transform(_d_form, x -> {body}), 1)")).drop("_d_form")


def _rejected(content: str) -> Column:
    """Is the content longer than a request may be?"""
    return F.coalesce(F.length(content) > MAX_LENGTH, F.lit(False))


def stage1(messages: DataFrame, content: str = "content") -> DataFrame:
    """Adds stage1_score, stage1_labels, evidence (spans without values) and hashed_tokens.

    Null content has no spans. Content beyond the length limit of a request is not detected: score, evidence
    and hashes are null, the label is message_too_long.
    """
    rejected = _rejected(content)
    text = F.when(F.length(content) <= MAX_LENGTH, F.col(content)).otherwise(F.lit(""))
    m = spread(messages).withColumn("_d_raw", F.coalesce(text, F.lit("")))
    m = m.withColumn("_d_clean", T.deobfuscate(F.col("_d_raw")))
    # One lambda over the forms of the text, so that every pattern is in the plan once.
    m = m.withColumns({"_d_raw_f": T.email_folded(F.col("_d_raw")), "_d_clean_f": T.email_folded(F.col("_d_clean"))})
    m = m.withColumns({"_d_low": L.folded(F.col("_d_raw")), "_d_clean_low": L.folded(F.col("_d_clean"))})
    m = m.withColumns({"_d_words": L.words_of(F.col("_d_low")), "_d_clean_words": L.words_of(F.col("_d_clean_low"))})
    raw, clean = "named_struct('t', _d_raw, 'f', _d_raw_f, 'l', _d_low, 'w', _d_words)", "named_struct('t', _d_clean, 'f', _d_clean_f, 'l', _d_clean_low, 'w', _d_clean_words)"
    m = m.withColumn("_d_forms", F.expr(f"IF(_d_clean <> _d_raw, array({raw}, {clean}), array({raw}))"))
    parts = S.joined([phone("x.t"), email("x.t", "x.f"), url("x.t"), social("x.t"), intent("x.t")])
    m = m.withColumns({"_d_all": F.expr(f"flatten(transform(_d_forms, x -> {parts}))"), "_d_obf": F.size(F.expr(obfuscation("_d_raw"))) > 0})
    m = m.withColumn("_d_spans", S.best_by_offset(F.col("_d_all")))
    label = lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in P.TYPE_LABELS.items() for x in kv]), t)
    first = F.when(F.col("_d_obf"), F.array(F.lit("obfuscation"))).otherwise(F.array().cast("array<string>"))
    labels = F.concat(first, F.array_distinct(F.transform("_d_spans", lambda s: label(s["type"]))))
    m = m.withColumn("stage1_labels", F.when(rejected, F.array(F.lit(TOO_LONG))).otherwise(labels))
    evidence = F.transform("_d_spans", lambda s: F.struct(s["off"].alias("offset"), s["len"].alias("length"), label(s["type"]).alias("type"), s["conf"].alias("confidence")))
    m = m.withColumn("evidence", F.when(~rejected, evidence))
    hashed = F.transform(F.filter("_d_spans", lambda s: (s["type"] != "intent") & (s["v"] != "")), lambda s: T.token_hash(s["v"]))
    m = m.withColumn("hashed_tokens", F.when(~rejected, F.array_distinct(hashed)))
    return m.withColumn("stage1_score", F.when(~rejected, F.round(_score1(), 3))).drop(*[c for c in m.columns if c.startswith("_d_")])


def _score1() -> Column:
    """Best weight times confidence, a little for each further contact type and for obfuscation of any."""
    top = lambda k: F.array_max(F.transform(F.filter("_d_spans", lambda s: s["type"] == k), lambda s: s["conf"] * P.TYPE_WEIGHTS[k]))
    contact = ["phone", "email", "url", "social"]
    best = F.greatest(*[F.coalesce(top(k), F.lit(0.0)) for k in [*contact, "intent"]])
    has = lambda k: F.exists("_d_spans", lambda s: s["type"] == k)
    n = sum((has(k).cast("int") for k in contact), F.lit(0))
    more = F.when(n > 1, F.least(F.lit(0.15), (n - 1) * 0.08)).otherwise(0.0)
    return F.when(F.size("_d_spans") == 0, 0.0).otherwise(F.least(best + more + F.when(F.col("_d_obf") & (n >= 1), 0.12).otherwise(0.0), F.lit(1.0)))


def cluster_hits(text: str) -> Column:
    """How many of the four intent clusters a text shows; its folded form and words are in ``_d_low`` and ``_d_words``."""
    return sum((F.coalesce(hit, F.lit(False)).cast("int") for hit in _cluster_tests(text).values()), F.lit(0))


def _with_words(messages: DataFrame, content: str) -> DataFrame:
    return messages.withColumn("_d_low", L.folded(F.col(content))).withColumn("_d_words", L.words_of(F.col("_d_low")))


def _cluster_tests(content: str) -> dict[str, Column]:
    return {k: F.expr(S.matches(content, group)) for k, (_, group) in P.CLUSTERS.items()}


def context_hits(messages: DataFrame, thread: str = "thread_id", order: str = "turn", content: str = "content", last: int = 5) -> DataFrame:
    """Adds ``context_hits``: cluster hits of the last messages before this one in its thread.

    Hits are counted per message first, so the window carries a number, not texts.
    """
    m = _with_words(messages, content).withColumn("_d_hits", cluster_hits(content)).drop("_d_low", "_d_words")
    before = Window.partitionBy(thread).orderBy(order).rowsBetween(-last, -1)
    return m.withColumn("context_hits", F.coalesce(F.sum("_d_hits").over(before), F.lit(0)).cast("int")).drop("_d_hits")


def stage2(messages: DataFrame, content: str = "content", ner: Column | None = None) -> DataFrame:
    """Adds stage2_score and stage2_labels to rows with ``context_hits``; ``ner`` is an optional score of entities."""
    m = _with_words(messages, content)
    m = m.withColumn("_d_hit", F.struct(*[F.coalesce(test, F.lit(False)).alias(k) for k, test in _cluster_tests(content).items()]))
    hit = {k: F.col(f"_d_hit.{k}") for k in P.CLUSTERS}
    n = sum((h.cast("int") for h in hit.values()), F.lit(0))
    base = F.greatest(*[F.when(h, F.lit(P.CLUSTERS[k][0])).otherwise(0.0) for k, h in hit.items()])
    base = F.when(n > 1, F.least(base + 0.10, F.lit(1.0))).otherwise(base)
    context = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.6)]), F.least(F.col("context_hits"), F.lit(3)) + 1)
    score = F.least(base + context * 0.15, F.lit(1.0))
    score = score if ner is None else F.greatest(score, ner * 0.6)
    labels = [F.when(n > 0, F.lit("nlp_intent")), F.when(n > 1, F.lit("multi_intent_signals")), F.when(context > 0.3, F.lit("context_escalation"))]
    evidence = F.expr(f"concat({', '.join(_cluster_spans(content, *c) for c in P.CLUSTERS.values())})")
    found = {"stage2_score": F.round(score, 3), "stage2_labels": F.array_compact(F.array(*labels)), "stage2_evidence": F.coalesce(evidence, F.expr(NO_EVIDENCE))}
    return m.withColumns(found).drop("_d_low", "_d_words", "_d_hit")


EVIDENCE = "struct<offset:int,length:int,type:string,confidence:double>"
NO_EVIDENCE = f"CAST(array() AS array<{EVIDENCE}>)"


def _cluster_spans(text: str, weight: float, group: list[str]) -> str:
    """All matches of a cluster's first pattern that matches."""
    each = lambda p: f"transform({S.found(text, p)}, m -> named_struct('offset', m.off, 'length', m.len, 'type', '{P.TYPE_LABELS['intent']}', 'confidence', {weight}D))"
    return "CASE " + " ".join(f"WHEN {S.matches(text, [p])} THEN {each(p)}" for p in group) + f" ELSE {NO_EVIDENCE} END"


def stage3_evidence(content: str = "content", n_thread: str = "n_thread") -> Column:
    """Persistence in a thread is evidence of the whole text."""
    n = F.col(n_thread)
    span = F.struct(F.lit(0).alias("offset"), F.length(content).alias("length"), F.lit(P.TYPE_LABELS["intent"]).alias("type"), F.least(F.lit(0.3) + (n - 3) * 0.1, F.lit(0.7)).alias("confidence"))
    return F.when(n >= 3, F.array(span)).otherwise(F.expr(NO_EVIDENCE))


def combine(scores: dict[int, Column], stages: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weighted mean over the requested stages, at least 0.8 of a score from 0.85 on.

    A stage asked for twice counts twice in the divisor only; an unknown one weighs nothing.
    """
    stages = stages or (1, 2, 3)
    total = sum(P.STAGE_WEIGHTS.get(s, 0.0) for s in stages)
    if not total:
        return F.lit(0.0)
    used = [s for s in dict.fromkeys(stages) if s in scores]
    mean = sum((scores[s] * P.STAGE_WEIGHTS[s] for s in used), F.lit(0.0)) / total
    most = F.greatest(*[scores[s] for s in used], F.lit(0.0))
    return F.round(F.least(F.when(most >= 0.85, F.greatest(mean, most * 0.8)).otherwise(mean), F.lit(1.0)), 3)


BATCH_LIMIT = 50


def analyze_batches(requests: DataFrame, limit: int = BATCH_LIMIT, failed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, refused): requests (batch_id, position, message_id, thread_id, user_id, content, created_at, kind) of one call each.

    A batch of more than ``limit`` messages is refused as a whole: (batch_id, n, reason). All others are analysed in all three stages, in order
    of (created_at, batch_id, position): a message sees what its user did in earlier calls and in earlier items of its own. A failed
    row is a result too (see ``detect``). Sizes of batches are summed before they meet their rows.
    """
    sizes = requests.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    refused = sizes.filter(F.col("n") > limit).withColumn("reason", F.lit("batch_too_large"))
    taken = requests.join(sizes.filter(F.col("n") <= limit).select(F.col("batch_id").alias("_q_batch")), F.col("batch_id") == F.col("_q_batch"), "left_semi")
    order = F.struct("batch_id", "position")
    scored = behavior.stage3_as_documented(taken.withColumn("_q_order", order), "created_at", "_q_order")
    return detect(scored, (1, 2, 3), "thread_id", "_q_order", failed).drop("_q_order"), refused


def highest_stage(scores: dict[int, Column]) -> Column:
    """The last stage that scored, else 1."""
    return F.greatest(F.lit(1), F.lit(1), *[F.when(c > 0, F.lit(s)).otherwise(1) for s, c in scores.items()])


#: The version of the rules that results carry, and that of rows that failed: fixed values.
RULESET_VERSION = FAILED_RULESET_VERSION = "1.0.0"


def detect(
    messages: DataFrame,
    stages: tuple[int, ...] = (1, 2),
    thread: str = "thread_id",
    order: str = "turn",
    failed: Column | None = None,
    ruleset_version: str = RULESET_VERSION,
    ner: Column | None = None,
    model_version: str | None = None,
) -> DataFrame:
    """Messages with the scores of the requested stages, the combined score, stage, labels, evidence, hashes and versions.

    ``ner`` is a score of entities for stage 2 and ``model_version`` names what made it; results carry that version only
    where stage 2 ran with it.

    No stages mean all three; stage 3 needs ``stage3_score``, ``stage3_labels`` and ``n_thread`` from ``behavior``. Content beyond
    the length limit has a null combined score and stage and the label message_too_long. Rows for which ``failed``
    holds are results as well: score 0, stage 0, the label analysis_error and no evidence.
    """
    stages = tuple(stages) or (1, 2, 3)
    m, scores, labels, evidence = messages, {}, [], [F.expr(NO_EVIDENCE)]
    if 1 in stages:
        m = stage1(m)
        scores[1], labels = F.col("stage1_score"), [*labels, F.col("stage1_labels")]
        evidence.append(F.col("evidence"))
    if 2 in stages:
        m = stage2(context_hits(m, thread, order), ner=ner)
        scores[2], labels = F.col("stage2_score"), [*labels, F.col("stage2_labels")]
        evidence.append(F.col("stage2_evidence"))
    if 3 in stages:
        scores[3], labels = F.col("stage3_score"), [*labels, F.col("stage3_labels")]
        evidence.append(stage3_evidence())
    rejected = _rejected("content")
    labels = [F.when(rejected, F.array(F.lit(TOO_LONG))).otherwise(F.array().cast("array<string>")), *labels]
    hashes = F.col("hashed_tokens") if 1 in stages else F.array().cast("array<string>")
    found = {"risk_score": combine(scores, stages), "stage": highest_stage(scores), "evidence": F.concat(*evidence), "hashed_tokens": hashes}
    found = {k: F.when(~rejected, c) for k, c in found.items()} | {"labels": F.array_distinct(F.concat(*labels))}
    model = model_version if 2 in stages and ner is not None else None
    found |= {"ruleset_version": F.lit(ruleset_version), "model_version": F.when(~rejected, F.lit(model).cast("string"))}
    if failed is not None:
        bad = F.coalesce(failed, F.lit(True))
        error = {"risk_score": F.lit(0.0), "stage": F.lit(0), "evidence": F.expr(NO_EVIDENCE), "hashed_tokens": F.array().cast("array<string>"), "labels": F.array(F.lit("analysis_error"))}
        error |= {"ruleset_version": F.lit(FAILED_RULESET_VERSION), "model_version": F.lit(None).cast("string")}
        found = {k: F.when(bad, error[k]).otherwise(c) for k, c in found.items()}
    return m.withColumns(found)
