"""Spans of pattern matches as typed arrays: extraction with offsets, greedy de-duplication, folds.

Everything is a SQL expression over a text column, so scans stay in the JVM. Offsets count
code points. Spark has no "all matches with positions", so a match is read together with the
gap before it (from where the last match ended) and lengths are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.literals import needed

SPAN = "struct<off:int,len:int,type:string,conf:double,v:string>"
NONE = f"CAST(array() AS array<{SPAN}>)"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(p: str) -> str:
    """A quoted regex that is Unicode-aware and ignores case, as the detectors' are."""
    return quoted(f"(?iuU)(?:{p})")


def any_of(text: str, terms: list[str]) -> str:
    """Does the text hold one of the terms as a substring?"""
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def low(text: str) -> str:
    """The name of the folded form of a text, which stands beside it."""
    return f"{text[:-1]}l" if text.endswith((".t", ".f")) else "_d_low"


def words(text: str) -> str:
    """The name of the words of a text."""
    return f"{text[:-1]}w" if text.endswith((".t", ".f")) else "_d_words"


def _kind(part: tuple[str, ...]) -> int:
    """Where literals are looked for: 0 the text itself (signs), 1 its folded form, 2 its words."""
    return 2 if all(x.startswith(" ") and x.endswith(" ") for x in part) else 1 if any(c.isalpha() or c == " " for x in part for c in x) else 0


def may(text: str, p: str) -> str:
    """Does the text hold the literals that a match needs? Signs are looked for in the text itself, letters in its folded form."""
    tests = [any_of((text, low(text), words(text))[_kind(part)], list(part)) for part in needed(p)]
    return " AND ".join(tests) if tests else "true"


def matches(text: str, patterns: list[str]) -> str:
    """Does the text match one of the patterns? Only those are searched for whose literals it holds."""
    return "(" + " OR ".join(f"({may(text, p)} AND {text} RLIKE {pattern(p)})" for p in patterns) + ")"


def around(text: str, start: str, end: str) -> str:
    """The part of the text from start to end, cut at its borders."""
    return f"substring({text}, greatest({start}, 0) + 1, {end} - greatest({start}, 0))"


def with_gaps(p: str) -> str:
    """Gap and match as two groups. \\G: a failed search must not start again at every character."""
    return quoted(rf"\G((?s:.*?))((?iuU)(?:{p}))")


def table(patterns: list[str], **fields: list) -> str:
    """Patterns as data: an array with the literals, the test and further fields of each, given as SQL. Words stand without blanks."""
    bare = lambda lits: [x.strip() if _kind(lits) == 2 else x for x in lits]
    part = lambda lits: f"named_struct('kind', {_kind(lits)}, 'lits', array({', '.join(map(quoted, bare(lits)))}))"
    none = "CAST(array() AS array<struct<kind:int,lits:array<string>>>)"
    # Words first: they say most and are looked up among the few that the text holds.
    need = lambda p: f"array({', '.join(map(part, sorted(needed(p), key=_kind, reverse=True)))})" if needed(p) else none
    rows = [f"named_struct('need', {need(p)}, 'test', {pattern(p)}, 'both', {with_gaps(p)}{''.join(f', {quoted(k)}, {v[i]}' for k, v in fields.items())})" for i, p in enumerate(patterns)]
    return f"array({', '.join(rows)})"


def candidates(text: str, rows: str, patterns: list[str]) -> str:
    """The rows of the ``table`` of ``patterns`` whose literals the text holds. The words of the text are read once for all rows."""
    listed = sorted({x.strip() for p in patterns for part in needed(p) if _kind(part) == 2 for x in part})
    # In a text of ASCII alone both classes are the same, and one is faster.
    between = f"IF(octet_length({low(text)}) = length({low(text)}), {quoted(r'\W+')}, {quoted(r'(?U)\W+')})"
    known = f"array_intersect(split({low(text)}, {between}), array({', '.join(map(quoted, listed))}))"
    holds = f"forall(y.need, z -> IF(z.kind = 2, arrays_overlap(z.lits, k), exists(z.lits, l -> contains(IF(z.kind = 0, {text}, {low(text)}), l))))"
    return f"element_at(transform(array({known}), k -> filter({rows}, y -> {holds})), 1)"


def each(rows: str, body: str) -> str:
    """The arrays that ``body`` makes of rows (``y``), one behind the other."""
    return f"flatten(transform({rows}, y -> {body}))"


def any_in(text: str, terms: str) -> str:
    """Does the text hold one of an array of terms?"""
    return f"exists({terms}, l -> contains({text}, l))"


#: A sign that no text should hold: what stands for a border of matches. Texts that do are read in another way.
BORDER = "\ufdd0"


def found(text: str, p: str | None, literals: bool = False) -> str:
    """array<struct<off, len, v>> of all matches of a pattern (None: of row ``y``) without capturing groups.

    One search puts borders around every match, so that gaps and matches follow each other. ``literals``: the text's
    folded form and words stand beside it and are looked at first.
    """
    first = may(text, p) if literals and p else "true"
    test, both = ("y.test", "y.both") if p is None else (pattern(p), with_gaps(p))
    none = "CAST(array() AS array<struct<off:int,len:int,v:string>>)"
    match = "array(named_struct('off', s.p, 'len', length(r), 'v', r))"
    once = (
        f"aggregate(split(regexp_replace({text}, {test}, '{BORDER}$0{BORDER}'), '{BORDER}'), named_struct('p', 0, 'm', false, 'o', {none}), "
        f"(s, r) -> named_struct('p', s.p + length(r), 'm', NOT s.m, 'o', IF(s.m, concat(s.o, {match}), s.o)), s -> s.o)"
    )
    gaps = (
        f"aggregate(zip_with(regexp_extract_all({text}, {both}, 1), regexp_extract_all({text}, {both}, 2), (g, v) -> named_struct('g', length(g), 'v', v)), "
        f"named_struct('p', 0, 'o', {none}), "
        "(s, r) -> named_struct('p', s.p + r.g + length(r.v), 'o', concat(s.o, array(named_struct('off', s.p + r.g, 'len', length(r.v), 'v', r.v)))), s -> s.o)"
    )
    return f"IF({first}, IF(contains({text}, '{BORDER}'), {gaps}, {once}), {none})"


def spans(text: str, p: str | None, kind: str, confidence: str, keep: str = "true", cut: float | str | None = None, **named: str) -> str:
    """array<SPAN>: matches (``m``) for which ``keep`` holds, with a confidence clamped to 0..1 and above ``cut``.

    ``named`` expressions become fields of ``m`` one after the other, so each is written and computed once.
    """
    at_most = f"least(greatest({confidence}, 0.0D), 1.0D)"
    out, fields = found(text, p, literals=True), ["off", "len", "v"]
    for name, value in named.items():
        out = f"transform({out}, m -> named_struct({', '.join(f'{chr(39)}{x}{chr(39)}, m.{x}' for x in fields)}, '{name}', {value}))"
        fields.append(name)
    out = f"transform(filter({out}, m -> {keep}), m -> named_struct('off', m.off, 'len', m.len, 'type', '{kind}', 'conf', {at_most}, 'v', m.v))"
    return out if cut is None else f"filter({out}, m -> m.conf > {cut if isinstance(cut, str) else f'{cut}D'})"


def joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else NONE


def greedy(parts: str) -> str:
    """Stable order by (offset, -confidence), then every span that overlaps no accepted one.

    Accepted spans are disjoint and in order, so the end of the last one decides.
    """
    numbered = f"transform({parts}, (m, i) -> named_struct('off', m.off, 'neg', -m.conf, 'i', i, 'm', m))"
    return (
        f"aggregate(transform(array_sort({numbered}), r -> r.m), named_struct('end', 0, 'o', {NONE}), "
        "(s, m) -> if(m.off < s.end, s, named_struct('end', m.off + m.len, 'o', concat(s.o, array(m)))), s -> s.o)"
    )


def best_by_offset(matches: Column) -> Column:
    """A span goes on when its (type, offset) is new or its confidence higher; earlier ones stay."""
    empty = F.array().cast(f"array<{SPAN}>")
    known = lambda acc, m: F.exists(acc, lambda a: (a["type"] == m["type"]) & (a["off"] == m["off"]) & (a["conf"] >= m["conf"]))
    return F.aggregate(matches, empty, lambda acc, m: F.when(known(acc, m), acc).otherwise(F.concat(acc, F.array(m))))
