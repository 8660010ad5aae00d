"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary file gives merge ranks; no identifiers are made. A word's symbols form a
linked list; the lowest-rank adjacent pair is popped from a heap, merged, and its two new
neighbours pushed. The number of tokens is the number of initial symbols minus the merges.
Counts of words are remembered in a bounded table of each Python worker.

Rows are independent: one narrow pass in Arrow batches, no shuffle.

Defined results: a null text counts as empty (0 bytes, 0 tokens); strings of special tokens
inside a text are one token each, as the library's default has it; texts of any length are
counted whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from os.path import commonprefix
from unicodedata import normalize

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 600_000


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Counts tokens as a tokenizers JSON file of word BPE with an end-of-word suffix says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        #: What all special strings begin with; a text without it holds none.
        self.special_start = commonprefix(special)
        self.letters = byte_letters()
        self.known: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """Initial symbols minus merges of one word."""
        symbols = [self.letters[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.suffix
        n = len(symbols)
        ranks = self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != merged or (symbols[i], symbols[j]) not in ranks:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = merged, None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((merged, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, merged + symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], merged))) is not None:
                heapq.heappush(heap, (r, h, symbols[h] + merged))
        return n - merges

    def count_plain(self, text: str) -> int:
        if not text.isascii():
            text = normalize("NFC", text)
        # Lower case is taken letter by letter; only the final sigma depends on its neighbours.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        known, total = self.known, 0
        for word in self.words.findall(text):
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.pieces(word)
                if len(word) < 100:
                    known[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or self.special_start not in text:
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


_loaded: dict[str, WordBpe] = {}


def counter(path: str) -> WordBpe:
    """One per Python worker, with its remembered words."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit); ``path`` is the vocabulary file, the same on every executor."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(path)
        for batch in batches:
            counts = pa.array([bpe.count(t.as_py() or "") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    source = docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {source.dtypes[0][1]}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
