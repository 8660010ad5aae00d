"""Vectorised hashes of words and word windows of many texts, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GROUP_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
_SLOTS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words per document) of UTF-8 bytes; words never span documents.

    A word's hash is a difference of prefix sums of letter codes times powers, shifted to power 0;
    prefix sums are made for pieces of about 1 MB that end between words.
    """
    solid = ~_IS_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    filled = doc_ends > doc_starts
    before[doc_starts[filled]] = False
    after[doc_ends[filled] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LETTER[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    counts = np.searchsorted(starts, doc_ends) - np.searchsorted(starts, doc_starts)
    return mix(out), counts


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run [start, end) of code points, by the same prefix sums."""
    up, down = _power_tables(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + U(1)) * up[: len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every ``width``-word window; a shorter document with words is one window."""
    firsts = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    docs = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(docs)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts, n)
    left = np.repeat(firsts + counts, n) - at
    out = np.zeros(len(docs), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out += np.where(left > k, padded[at + k] * _SLOTS[k], U(0))
    return docs, mix(out)


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends) of runs of rows of about ``most`` bytes; nulls are empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        yield i, j, data[lo:hi], offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo
        i = j
