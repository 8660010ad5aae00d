"""SentencePiece encoding and decoding with a max-plus parallel scan over giant documents.

The model file at hand is a BPE model: its encoding is not the path of highest summed piece
scores, so plain Viterbi would give other pieces than the library. The lattice used here
gives the library's: a path may go from piece a to piece b (weight 0) only if BPE of their
joined text is again a, b; any other step has weight minus infinity. Merges never cross a
border that is final, so a path of weight 0 exists, is unique and is the BPE encoding.

A giant document is cut into chunks. The state at a cut is (characters by which a piece
reaches past it, that piece). Each chunk yields its transfer matrix between the states at
its two cuts, as the set of entries that are 0; entries that no path from the last border of
units before the cut reaches are left out. Matrices are combined associatively (max of sums
is "or" of "and" for weights 0 and minus infinity), in parallel: blocks of ``BLOCK`` chunks are
multiplied, the few products of a text (a text holds 2 GB at most) give the states at the
borders of blocks, and each block then gives the states at its own cuts. Every chunk is
backtraced between its two states, alone.

Inside a chunk, units (a run of word-start marks with the text behind it) are independent,
as no piece has a mark after another character. A whole unit's path is BPE of the unit by
definition; the distinct units of about ``GROUP_CHARS`` characters are merged side by side in
arrays, so memory is bounded and nothing is kept between batches but pair checks of the
lattice (``REMEMBERED`` at most). Only the parts of units next to a cut need the lattice.

Defined results: a null text is encoded as an empty one (no ids); texts of any length are
encoded whole; characters outside the vocabulary become byte pieces; U+2581 in a text is
read as a space, as the library does; repeated texts share the work on giants and each row
gets its result; an empty table gives no rows; clashing extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from brindle.llm.text_hashes import run_hashes

MARK = "▁"
CHUNK = 16_384
BLOCK = 512
GROUP_CHARS = 1 << 19
REMEMBERED = 50_000
LONG_UNIT = 64
NO_PAIR = np.iinfo(np.int32).max
LETTER = re.compile(r"[^\W\d_]")
IS_MARK, IS_HARD, IS_LETTER, IS_ENDING = 1, 2, 4, 8
#: Fixed value: piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of many runs (start, size), one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Ids that lie one row after the other as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32), pa.int32()), pa.array(ids, pa.int32()))


class PieceLattice:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = {p: sp.get_score(i) for i, p in enumerate(pieces) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))}
        self.ids = {p: i for i, p in enumerate(pieces) if p in self.scores}
        self.byte_ids = {int(pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = pa.array([bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.longest = max(map(len, self.ids))
        letters = {c for p in self.ids for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word-start mark after another character")
        self.hard = {c for c in "\n\t" if c not in letters}
        # Characters that follow a letter in no piece: a border lies between a letter and such a one.
        follow = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if LETTER.match(a)}
        self.ending = {c for c in letters if not LETTER.match(c) and c != MARK and c not in follow}
        self.fits: dict[tuple[str, str], bool] = {}
        self._arrays(n)

    def _arrays(self, n: int) -> None:
        """Tables for merging in arrays: a symbol is a piece's id, or ``n`` plus a code point that is no piece."""
        self.n = n
        every = range(0x110000)
        self.classes = np.fromiter((IS_LETTER if chr(c).isalnum() and not chr(c).isdecimal() else 0 for c in every), np.uint8, len(every))
        for chars, flag in ((MARK, IS_MARK), (self.hard, IS_HARD), (self.ending, IS_ENDING)):
            for c in chars:
                self.classes[ord(c)] |= flag
        self.symbols = np.arange(n, n + len(every), dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        name = lambda x: self.ids.get(x, n + ord(x) if len(x) == 1 else None)
        found = [(a << 21 | b, order[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := name(p[:k])) is not None and (b := name(p[k:])) is not None]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        # Pairs by open addressing: whoever finds its slot taken goes to the next.
        bits = max(8, (8 * len(table)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_keys, self.pair_ranks, self.pair_symbols = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_PAIR, np.int32), np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(table)), self._slots(table[:, 0])
        while len(todo):
            free = self.pair_keys[slot[todo]] < 0
            self.pair_keys[slot[todo[free]]] = table[todo[free], 0]  # of several with one slot the last stays
            todo = todo[self.pair_keys[slot[todo]] != table[todo, 0]]
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
        self.pair_ranks[slot], self.pair_symbols[slot] = table[:, 1], table[:, 2]
        self.byte_table = np.array([self.byte_ids[b] for b in range(256)], np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of neighbours (``NO_PAIR`` where there is none) and its symbol."""
        key = left.astype(np.int64) << 21 | right
        at = self._slots(key)
        found = self.pair_keys[at]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.pair_keys) - 1)
            found[todo] = self.pair_keys[at[todo]]
            todo = todo[(found[todo] != key[todo]) & (found[todo] >= 0)]
        return self.pair_ranks[at], self.pair_symbols[at]  # an empty slot has no pair

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many units (symbols one unit after the other, symbols per unit): in each step every unit has its best merge."""
        unit, out = np.arange(len(sizes)), []
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        rank, merged = np.full(len(symbols), NO_PAIR, np.int32), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], merged[:-1] = self._pairs(symbols[:-1], symbols[1:])
        rank[last] = NO_PAIR
        while len(unit):
            best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), np.cumsum(sizes) - sizes)
            alive = best < NO_PAIR << 32
            chosen = np.zeros(len(symbols), bool)
            chosen[(best & 0xFFFFFFFF)[alive]] = True
            if not alive.all():
                here = np.repeat(alive, sizes)
                out.append((unit[~alive], sizes[~alive], symbols[~here]))
                unit, sizes = unit[alive], sizes[alive]
                symbols, rank, merged, last, chosen = (x[here] for x in (symbols, rank, merged, last, chosen))
                if not len(unit):
                    break
            at = np.flatnonzero(chosen)
            symbols[at], last[at] = merged[at], last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank, merged, last = (x[keep] for x in (symbols, rank, merged, last))
            at -= np.arange(len(at))
            sizes = sizes - 1
            changed = np.concatenate([at, at[at > np.cumsum(sizes) - sizes] - 1])
            rank[changed] = NO_PAIR
            changed = changed[~last[changed]]
            rank[changed], merged[changed] = self._pairs(symbols[changed], symbols[changed + 1])
        total = np.zeros(sum(len(u) for u, _, _ in out), np.int64)
        for u, n, _ in out:
            total[u] = n
        flat, first = np.zeros(int(total.sum()), np.int32), np.cumsum(total) - total
        for u, n, s in out:
            flat[ragged(first[u], n)] = s
        return flat, total

    def encode_normal(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts of whole units, one text after the other, and where each ends."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = self.classes[points]
        before = np.append(np.uint8(IS_HARD), kind[:-1])
        border = ((kind | before) & IS_HARD > 0) | ((kind & IS_MARK > 0) & (before & IS_MARK == 0)) | ((before & IS_LETTER > 0) & (kind & IS_ENDING > 0))
        border[ends[:-1][ends[:-1] < len(points)]] = True
        starts = np.flatnonzero(border)
        sizes = np.diff(np.append(starts, len(points)))
        which, inverse = self._distinct(points, starts, sizes)
        symbols, n = self._merged(joined, points, starts[which], sizes[which])
        per_unit = n[inverse]
        flat = symbols[ragged((np.cumsum(n) - n)[inverse], per_unit)]
        ids, id_ends = self._to_ids(flat)
        unit_ends = np.append(0, np.append(0, id_ends)[np.cumsum(per_unit)])
        return ids, unit_ends[np.searchsorted(starts, ends)]

    @staticmethod
    def _distinct(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One unit of each kind, and the kind of every unit; hashes say which may be equal, a comparison that they are."""
        _, which, inverse = np.unique(run_hashes(points, starts, starts + sizes), return_index=True, return_inverse=True)
        like = which[inverse]
        if not (sizes[like] == sizes).all() or not (points[ragged(starts[like], sizes)] == points).all():
            return np.arange(len(starts)), np.arange(len(starts))
        return which, inverse

    def _merged(self, joined: str, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = sizes <= LONG_UNIT
        flat, n = self.merge_many(self.symbols[points[ragged(starts[short], sizes[short])]], sizes[short])
        if short.all():
            return flat, n
        long = [np.array([self.ids.get(p, self.n + ord(p[0])) for p in self.merge(joined[s : s + k])], np.int32) for s, k in zip(starts[~short], sizes[~short], strict=True)]
        total = np.zeros(len(starts), np.int64)
        total[short], total[~short] = n, [len(x) for x in long]
        first, out = np.cumsum(total) - total, np.zeros(int(total.sum()), np.int32)
        out[ragged(first[short], n)], out[ragged(first[~short], total[~short])] = flat, np.concatenate(long)
        return out, total

    def _to_ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and where each symbol's end: characters that are no piece give their bytes."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols, np.arange(1, len(symbols) + 1)
        points, of = np.unique(symbols[odd] - self.n, return_inverse=True)
        coded = [chr(c).encode("utf-8", "replace") for c in points]
        width, n = np.array([len(c) for c in coded]), np.ones(len(symbols), np.int64)
        raw = np.array([list(c.ljust(4, b"\0")) for c in coded])
        n[odd] = width[of]
        ends = np.cumsum(n)
        out = np.zeros(int(ends[-1]), np.int32)
        out[ends - n] = symbols
        for k in range(4):
            has = width[of] > k
            out[(ends - n)[odd[has]] + k] = self.byte_table[raw[of[has], k]]
        return out, ends

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after the other, and where each ends; in groups of bounded size."""
        ids, ends, at, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and (not group or size < GROUP_CHARS):
                group.append(self.normal(texts[i]))
                size += len(group[-1])
                i += 1
            found, stop = self.encode_normal(group)
            ids.append(found)
            ends.append(stop + at)
            at += len(found)
        return np.concatenate(ids), np.concatenate(ends)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: best score first, leftmost among equals."""
        return self._merge_short(text) if len(text) <= 40 else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        symbols, score, none = list(text), self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], none)
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        scores = self.scores
        heap = [(-s, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (s := scores.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != merged:
                continue
            symbols[i], symbols[j] = merged, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := scores.get(merged + symbols[k])) is not None:
                    heapq.heappush(heap, (-s, i, merged + symbols[k]))
            if (h := before[i]) >= 0 and (s := scores.get(symbols[h] + merged)) is not None:
                heapq.heappush(heap, (-s, h, symbols[h] + merged))
        return [x for x in symbols if x is not None]

    def weight_0(self, a: str | None, b: str) -> bool:
        """May piece b follow piece a?"""
        if a is None or (a[-1] != MARK and b[0] == MARK) or a[-1] in self.hard or b[0] in self.hard:
            return True
        key = a, b
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            ok = self.fits[key] = self.merge(a + b) == [a, b]
        return ok

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces that can start at a position, longest first; a character of no piece stands for itself."""
        for end in range(min(len(text), at + self.longest), at + 1, -1):
            if text[at:end] in self.ids:
                yield text[at:end]
        yield text[at]

    def path(self, text: str, at: int, last: str | None, goal: int, goal_piece: str | None = None) -> list[str] | None:
        """The pieces of the path of weight 0 from a state to a position (and last piece), or None."""
        stack = [self.starting(text, at)]
        places, taken, dead = [(at, last)], [], set()
        while stack:
            place, before = places[-1]
            if place == goal and (goal_piece is None or before == goal_piece):
                return taken
            found = None
            if place < goal:
                for piece in stack[-1]:
                    if place + len(piece) <= goal and (place + len(piece), piece) not in dead and self.weight_0(before, piece):
                        found = piece
                        break
            if found is None:
                dead.add((place, before))
                stack.pop()
                places.pop()
                if taken:
                    taken.pop()
            else:
                taken.append(found)
                places.append((place + len(found), found))
                stack.append(self.starting(text, place + len(found)) if place + len(found) < goal else iter(()))
        return None

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "replace"))
        return out

    def is_border(self, text: str, b: int) -> bool:
        """Does a unit begin (or the text end) at a position?"""
        return b in (0, len(text)) or text[b] in self.hard or text[b - 1] in self.hard or (text[b] == MARK and text[b - 1] != MARK)

    def borders(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """First and last position in [start, end] that is a border of units."""
        first = next((b for b in range(start, end + 1) if self.is_border(text, b)), None)
        return None if first is None else (first, next(b for b in range(end, first - 1, -1) if self.is_border(text, b)))

    def states(self, text: str, cut: int) -> list[tuple[int, str]]:
        """States that are possible at a cut: (characters past it, piece that ends there)."""
        out = []
        for past in range(min(self.longest, len(text) - cut + 1)):
            end = cut + past
            for start in range(max(0, end - self.longest), cut):
                if text[start:end] in self.ids or end - start == 1:
                    out.append((past, text[start:end]))
        return out

    def reach(self, text: str, at: int, last: str | None, cut: int) -> list[tuple[int, str]]:
        """States at ``cut`` to which a path of weight 0 leads."""
        todo, seen, out = [(at, last)], {(at, last)}, set()
        while todo:
            place, before = todo.pop()
            if place >= cut:
                out.add((place - cut, before))
                continue
            for piece in self.starting(text, place):
                state = place + len(piece), piece
                if state not in seen and self.weight_0(before, piece):
                    seen.add(state)
                    todo.append(state)
        return sorted(out, key=_order)

    def entries(self, text: str, start: int) -> list[tuple]:
        """States that are possible at a chunk's start; what is before it in ``text`` is context.

        A border of units is the state (0, None). After a border in the context only the states count to which it leads.
        """
        if self.is_border(text, start):
            return [(0, None)]
        near = self.borders(text, 1, start)
        return self.states(text, start) if near is None else self.reach(text, near[1], None, start)

    def matrix(self, text: str, start: int, end: int) -> dict[tuple, list[tuple]]:
        """Entries of weight 0 of a chunk [start, end) of ``text``, which has context on both sides."""
        entries, between = self.entries(text, start), self.borders(text, start, end)
        if between is None:
            rows = {e: self.reach(text, start + e[0], e[1], end) for e in entries}
        else:
            exits = [(0, None)] if between[1] == end else self.reach(text, between[1], None, end)
            rows = {e: exits for e in entries if start + e[0] <= between[0] and self.path(text, start + e[0], e[1], between[0]) is not None}
        return {e: x for e, x in rows.items() if x}

    def chunk_parts(self, text: str, start: int, end: int, entry: tuple, leave: tuple) -> tuple[list[int], str, list[int]]:
        """Backtrace of one chunk between its two states: ids, a text of whole units, ids."""
        at, goal = start + entry[0], end + leave[0]
        between = self.borders(text, at, end) if at <= end else None
        if between is None:
            return self.to_ids(self.path(text, at, entry[1], goal, leave[1]) or []), "", []
        head, tail = self.path(text, at, entry[1], between[0]), self.path(text, between[1], None, goal)
        return self.to_ids(head), text[between[0] : between[1]], self.to_ids(tail)

    def encode_chunks(self, parts: list[tuple[list[int], str, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks given by ``chunk_parts``, one after the other, and where each ends."""
        out, sizes = [np.zeros(0, np.int32)], []
        for head, units, tail in parts:
            out += [np.array(head, np.int32), self.encode_normal([units])[0], np.array(tail, np.int32)]
            sizes.append(sum(map(len, out[-3:])))
        return np.concatenate(out), np.cumsum(sizes)

    def normal(self, text: str | None) -> str:
        """The model's normal form: a mark in front, marks for spaces (identity otherwise)."""
        return MARK + text.replace(" ", MARK) if text else ""

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id sequences that lie one after the other; ``ends`` are their ends in ``ids``."""
        taken = self.bytes.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
        data = taken.buffers()[2].to_pybytes() if len(ids) else b""
        at = at[np.append(0, ends)] - at[0]
        return [data[i:j].decode("utf-8", "replace").removeprefix(" ") for i, j in zip(at[:-1], at[1:], strict=True)]


def states_at_cuts(steps: list[dict], entry: tuple, leave: tuple) -> list[tuple]:
    """The states of the path of weight 0 before, between and behind matrices in a row."""
    reached = [{entry}]
    for m in steps:
        reached.append({x for e in reached[-1] for x in m.get(e, ())})
    out = [leave]
    for m, before in zip(reversed(steps), reversed(reached[:-1]), strict=True):
        out.append(next(e for e in sorted(before, key=_order) if out[-1] in m.get(e, ())))
    return out[::-1]


def _order(state: tuple) -> tuple:
    return state[0], state[1] or ""


def compose(a: dict[tuple, list[tuple]], b: dict[tuple, list[tuple]]) -> dict[tuple, list[tuple]]:
    """Max-plus product of two transfer matrices of weights 0 and minus infinity."""
    out = {}
    for entry, middle in a.items():
        if reached := sorted({x for m in middle for x in b.get(m, ())}, key=_order):
            out[entry] = reached
    return out


_loaded: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    if path not in _loaded:
        _loaded[path] = PieceLattice(path)
    return _loaded[path]


def _pack(matrix: dict[tuple, list[tuple]]) -> str:
    exits = sorted({tuple(x) for v in matrix.values() for x in v}, key=_order)
    at = {x: i for i, x in enumerate(exits)}
    return json.dumps([exits, [[*e, [at[tuple(x)] for x in v]] for e, v in matrix.items()]])


def _unpack(text: str) -> dict[tuple, list[tuple]]:
    exits, rows = json.loads(text)
    return {(o, last): [tuple(exits[i]) for i in v] for o, last, v in rows}


STATES = "key string, {id} int, o int, last string, xo int, xlast string"


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``n`` columns, one group at a time."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:n]):
        yield key, list(group)


def _states_batch(key: str, of: str, ids: list[int], states: list[tuple]) -> pa.RecordBatch:
    """The state before and behind each of the matrices in a row."""
    columns = [[key] * len(ids), ids, *([s[i] for s in part] for part in (states[:-1], states[1:]) for i in (0, 1))]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", of, "o", "last", "xo", "xlast"])


def scan(matrices: DataFrame) -> DataFrame:
    """(key, k, o, last, xo, xlast): the states at the two cuts of every chunk, from (key, block, k, m).

    Three steps over sorted rows, each holding at most ``BLOCK`` matrices: products of blocks, states at the
    borders of blocks, states inside blocks. The number of partitions is given, so that the
    few bytes of matrices are not put in one task.
    """
    n = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = matrices.select("key", "block", "k", "m").repartition(n, "key", "block")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in _grouped(batches, 2):
            whole = _pack(reduce(compose, [_unpack(r[3]) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([block], pa.int32()), pa.array([whole], pa.string())], ["key", "block", "m"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), rows in _grouped(batches, 1):
            yield _states_batch(key, "block", [r[1] for r in rows], states_at_cuts([_unpack(r[2]) for r in rows], (0, None), (0, None)))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), rows in _grouped(batches, 2):
            yield _states_batch(key, "k", [r[2] for r in rows], states_at_cuts([_unpack(r[3]) for r in rows], rows[0][4:6], rows[0][6:8]))

    products = blocks.sortWithinPartitions("key", "block", "k").mapInArrow(product, "key string, block int, m string")
    ends = products.repartition(n, "key").sortWithinPartitions("key", "block").mapInArrow(borders, STATES.format(id="block"))
    met = blocks.join(ends, ["key", "block"]).select("key", "block", "k", "m", "o", "last", "xo", "xlast")
    return met.sortWithinPartitions("key", "block", "k").mapInArrow(inside, STATES.format(id="k"))


def _giants(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(key, ids) of the distinct texts of ``docs`` (key, text)."""
    margin = lattice(path).longest
    spaced = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    texts = docs.groupBy("key").agg(F.first("text").alias("text")).select("key", spaced.alias("t"))
    chunks = texts.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chunk).cast("int"))))
    start = F.col("k") * chunk
    left = F.least(F.lit(margin), start)
    chunks = chunks.select("key", "k", left.alias("left"), F.least(F.lit(chunk), F.length("t") - start).alias("size"), F.expr(f"substring(t, k * {chunk} - least({margin}, k * {chunk}) + 1, least({margin}, k * {chunk}) + {chunk} + {margin})").alias("part"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        for b in batches:
            out = [_pack(lat.matrix(p, le, le + n)) for le, n, p in zip(*(b.column(i).to_pylist() for i in range(2, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["key", "k", "m"])

    found = chunks.mapInArrow(matrices, "key string, k int, m string")
    states = scan(found.withColumn("block", F.floor(F.col("k") / BLOCK).cast("int")))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("left", "size", "part", "o", "last", "xo", "xlast")), strict=True)
            ids = lat.encode_chunks([lat.chunk_parts(p, le, le + n, (o, last), (xo, xlast)) for le, n, p, o, last, xo, xlast in rows])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), id_lists(*ids)], ["key", "k", "ids"])

    parts = chunks.join(states, ["key", "k"]).mapInArrow(traced, "key string, k int, ids array<int>")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])
    return parts.groupBy("key").agg(F.flatten(ordered).alias("ids"))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about ``GROUP_CHARS`` bytes."""
    sizes = np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + GROUP_CHARS, "right")) - 1)
        yield i, j
        i = j


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with a column of piece ids, equal to the library's for the model at ``path``.

    With ``decoded_col`` the text of the ids comes as well, as ``decode`` gives it, made in the same pass.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    names = [c for c in docs.columns if c not in (out_col, decoded_col)]
    work = docs.select(*names, F.col(text_col).alias("_sp_text"))
    long = F.coalesce(F.length("_sp_text"), F.lit(0)) >= chunk
    made = [out_col, *([decoded_col] if decoded_col else [])]
    schema = StructType([docs.schema[n] for n in names] + [StructField(out_col, ArrayType(IntegerType()))] + [StructField(n, StringType()) for n in made[1:]])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows go out in small batches, so results of a large one are never held together."""
        lat = lattice(path)
        for batch in batches:
            for i, j in _slices(batch.column(at)):
                rows = batch.slice(i, j - i)
                ids, ends = lat.encode_many(rows.column(at).to_pylist())
                out = [*rows.columns[: len(names)], id_lists(ids, ends)]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(lat.decode(ids, ends), pa.string())] if decoded_col else []), [*names, *made])

    at = names.index(text_col) if text_col in names else len(names)
    small = work.filter(~long)
    small = (small.drop("_sp_text") if text_col in names else small).mapInArrow(whole, schema)
    giant = work.filter(long).withColumn("_sp_key", F.md5("_sp_text"))
    found = _giants(giant.select(F.col("_sp_key").alias("key"), F.col("_sp_text").alias("text")), path, chunk)
    giant = giant.join(found.select(F.col("key").alias("_sp_key"), F.col("ids").alias(out_col)), "_sp_key")
    giant = decode(giant, path, out_col, decoded_col) if decoded_col else giant
    return small.unionByName(giant.select(*names, *made))


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of piece ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        lat = lattice(path)
        lists = ids.fill_null([]) if ids.null_count else ids
        start, flat = lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)
        texts = lat.decode(flat, lists.offsets.to_numpy()[1:] - start)
        return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False)) if ids.null_count else pa.array(texts, pa.string())

    return docs.withColumn(out_col, text(ids_col))
