"""Text normalisation as Column functions; only texts that need NFD or NFKC, which Spark lacks, go to an Arrow UDF."""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are dropped or folded, in code point order of their blocks.
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\ufeff\u2060\u2061\u2062\u2063\u2064\u206a\u206b\u206c\u206d\u206e\u206f"
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "\U0001d41a": "A", "\U0001d41b": "B", "\U0001d41c": "C", "\U0001d41d": "D", "\U0001d41e": "E", "ı": "i", "ȷ": "j",
}
EMAIL_HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h"}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "(": "c", "[": "c", "<": "c"}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "o": "0", "one": "1", "won": "1", "two": "2", "to": "2", "too": "2", "three": "3", "tree": "3",
    "four": "4", "for": "4", "fore": "4", "five": "5", "six": "6", "sicks": "6", "seven": "7", "eight": "8", "ate": "8", "nine": "9", "niner": "9",
}
FULLWIDTH = range(0xFF01, 0xFF5F)


def _fold(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def fold_homoglyphs(text: Column) -> Column:
    return _fold(text, HOMOGLYPHS)


def fold_fullwidth(text: Column) -> Column:
    return _fold(text, {chr(c): chr(c - 0xFEE0) for c in FULLWIDTH})


def fold_leet(text: Column) -> Column:
    return _fold(text, LEET)


def _strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


#: Characters that are looked at one by one; a text that holds others, or such as only Python folds, goes to Python.
BLOCKS = (range(0x0, 0x530), range(0x1E00, 0x20D0), range(0x2190, 0x27C0), range(0x3000, 0x3100), range(0x4E00, 0xA000), range(0xFE00, 0xFE10), range(0xFEFF, 0xFF5F), range(0x1D41A, 0x1D41F), range(0x1F300, 0x1F650), range(0x1F900, 0x1FA00))
#: Texts that Python holds at a time, of an Arrow batch.
ROWS = 256


def _is_stable(c: str) -> bool:
    """Is a text of such characters its own NFKC? No marks and none that are assigned later; in these blocks only marks join what is before them."""
    return unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and _nfkc(c) == c


def _beyond(chars: list[int]) -> str:
    """A regex for any other character: the longest ranges are tested first, the others only behind them."""
    ranges: list[list[int]] = []
    for c in sorted(chars):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    latin = [r for r in ranges if r[0] < 0x100]
    long = sorted(latin, key=lambda r: r[0] - r[1])[:2] + sorted((r for r in ranges if r not in latin), key=lambda r: r[0] - r[1])[:4]
    of = lambda some: "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in some)
    return f"[^{of(long)}](?<![{of([r for r in ranges if r not in long])}])"


@cache
def changed_by_nfkc() -> str:
    """A regex for characters that may change a text's NFKC."""
    return _beyond([c for block in BLOCKS for c in block if _is_stable(chr(c))])


@cache
def _each_alone() -> tuple[str, dict[str, str]]:
    """A regex for characters that ``deobfuscate`` does not fold one by one, and what it makes of those that it does where it changes them."""
    plain = {chr(c): _deobfuscated(chr(c)) for block in BLOCKS for c in block}
    # Marks are dropped, whatever is before them; what is left stays as it is.
    alone = {c: p for c, p in plain.items() if unicodedata.category(c) != "Cn" and len(p) <= 1 and len(_strip_marks(c.translate(_FIRST))) == len(p) and all(map(_is_stable, p))}
    return _beyond([*map(ord, alone)]), {c: p for c, p in alone.items() if c != p}


def _by_text(f):
    """An Arrow UDF over texts, a few at a time; null texts cost nothing."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else f(t) for t in texts.slice(i, ROWS).to_pylist()], pa.string()) for i in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def _where(text: Column, odd: str, f, otherwise: Column) -> Column:
    """``f`` in Python for texts that hold what ``odd`` finds, which alone are sent there; all others stay in the JVM."""
    return F.coalesce(_by_text(f)(F.when(text.rlike(odd), text)), otherwise)


def strip_marks(text: Column) -> Column:
    return _where(text, r"[^\x00-\x7F]", _strip_marks, text)


def nfkc(text: Column) -> Column:
    return _where(text, changed_by_nfkc(), _nfkc, text)


_FIRST = str.maketrans(HOMOGLYPHS | {chr(c): chr(c - 0xFEE0) for c in FULLWIDTH} | dict.fromkeys(ZERO_WIDTH))
_THEN = str.maketrans(LEET)


def _deobfuscated(text: str) -> str:
    return _nfkc(_strip_marks(text.translate(_FIRST)).translate(_THEN))


def deobfuscate(text: Column) -> Column:
    """Zero-width, homoglyphs, fullwidth, marks, leet, NFKC: the order is part of the meaning.

    Most characters are folded each for itself, by one table of all steps; Python folds the texts that hold others.
    """
    odd, table = _each_alone()
    kept = {c: p for c, p in table.items() if p}
    dropped = "".join(c for c, p in table.items() if not p)
    return _where(text, odd, _deobfuscated, F.translate(text, "".join(kept) + dropped, "".join(kept.values())))


def email_folded(text: Column) -> Column:
    return _fold(nfkc(text), EMAIL_HOMOGLYPHS)


def token_hash(value: Column) -> Column:
    """SHA-256 of the value without outer white space, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), 256)
