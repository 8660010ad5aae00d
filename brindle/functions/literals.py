"""Which literals a match of a pattern must hold: what lets most texts pass by most patterns.

A pattern is read into its parts. A match holds every part that is not optional: a run of letters is one literal, an
alternation is one of the literals of its branches (of each branch the part that says most). A text that lacks a part has no
match, so patterns stay tables of data and only the few that can match are searched for. Literals are in lower case and
looked for in ``folded`` texts; those that stand between borders or white space are words, with a blank on
either side, and looked for in ``words_of`` them.
"""

from __future__ import annotations

from functools import cache
from re import PatternError
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a search without regard to case takes for ASCII ones though their small form is another, and what they are taken for.
ODD_CASE = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}
#: More literals than this in a part say little about a text.
MOST = 40
Parts = list[frozenset[str]]


def folded(text: Column) -> Column:
    """The text as literals are looked for in it; as many letters as before."""
    odd = F.translate(text, "".join(ODD_CASE), "".join(ODD_CASE.values()))
    return F.lower(F.when(text.rlike(f"[{''.join(ODD_CASE)}]"), odd).otherwise(text))


def words_of(folded: Column) -> Column:
    """The words of a folded text, each between blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(folded, r"(?U)\W+", " "), F.lit(" "))


def _best(parts: Parts) -> frozenset[str] | None:
    """The part that says most: its shortest literal is the longest, then there are fewest."""
    return max(parts, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _strings(op, value) -> frozenset[str] | None:
    """All texts that an item matches, where they are few."""
    if op is C.LITERAL:
        return frozenset([chr(value).lower()])
    if op is C.IN and all(kind is C.LITERAL for kind, _ in value):
        return frozenset(chr(c).lower() for _, c in value)
    if op is C.SUBPATTERN:
        return _product(value[-1])
    if op is C.BRANCH:
        found = [_product(branch) for branch in value[1]]
        return frozenset().union(*found) if None not in found else None
    return None


def _product(items) -> frozenset[str] | None:
    out = frozenset([""])
    for item in items:
        found = _strings(*item)
        if found is None or len(out) * len(found) > MOST:
            return None
        out = frozenset(x + y for x in out for y in found)
    return out


def _is_edge(item) -> bool:
    """Is the item a border of words, or white space?"""
    if item[0] in (C.MAX_REPEAT, C.MIN_REPEAT):
        return item[1][0] > 0 and list(item[1][2]) == [(C.IN, [(C.CATEGORY, C.CATEGORY_SPACE)])]
    return item == (C.AT, C.AT_BOUNDARY)


def _parts(items, left: bool = False, right: bool = False) -> Parts:
    """Parts of a sequence; ``left`` and ``right`` say whether it stands between edges."""
    items, out, i = list(items), [], 0
    before = lambda k: left if k == 0 else _is_edge(items[k - 1])
    behind = lambda k: right if k == len(items) else _is_edge(items[k])
    while i < len(items):
        j, run = i, frozenset([""])
        while j < len(items) and (found := _strings(*items[j])) is not None and len(run) * len(found) <= MOST:
            run, j = frozenset(x + y for x in run for y in found), j + 1
        if j < len(items) and items[j][0] is C.BRANCH:  # what stands before it belongs to every branch
            branches = [_best(_parts(items[i:j] + list(branch), before(i), behind(j + 1))) for branch in items[j][1][1]]
            out += [frozenset().union(*branches)] if all(branches) else []
            i = j + 1
        elif j > i:
            whole = before(i) and behind(j) and all(x.isalnum() for x in run)
            out += [frozenset(f" {x} " for x in run) if whole else run] if all(run) else []
            i = j
        else:
            op, value = items[i]
            if op is C.SUBPATTERN:
                out += _parts(value[-1], before(i), behind(i + 1))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                out += _parts(value[2])
            i += 1
    return out


@cache
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Parts of which a match holds each, as the literals of which it holds one; none where nothing is known."""
    try:
        parts = _parts(_parser.parse(pattern))
    except PatternError:  # classes that only Java has
        return ()
    return tuple(sorted({tuple(sorted(s)) for s in parts if len(s) <= MOST}))
