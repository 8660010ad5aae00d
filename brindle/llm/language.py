"""Language identification of mixed text: script ranges, then Viterbi over word scores.

Fitting counts character 1- to 3-grams of words by language over a bounded sample of labelled
documents (``sample_docs``, chosen by hash of id; counting runs in Spark, only the
``max_grams`` most frequent grams and the counts of scripts come to the driver). A word's score for a
language is its grams' log-likelihood. The script of a word, found in a table of code point ranges, leaves
only the languages that were seen in that script. Viterbi with a switching penalty then labels every
word, so spans of one language come out whole.

Prediction is one narrow pass over arrays of code points: ``SLICE`` characters are scored at
once, with one look-up per distinct gram, and nothing is kept from one slice to the next but
the scores of a group's words. A word whose best score leads by more than twice the penalty has
that label on every best path, so sequences are cut at such words and decoded side by side.

Defined results: null texts and texts without letters are ``und`` with score 0 and no spans; letters of
scripts that no learned language uses have no label and lower the score; a text of only such letters gets
the language with most letters in the sample, with score 0; ties go to the first language by
name; without labelled rows every text is ``und``; texts are read whole: a run of letters is cut
where its script changes and after every ``PIECE`` characters, and each piece is a word; repeated
rows get equal results; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.workers import giving_back

PIECE = 64
SLICE = 1 << 18
GROUP_WORDS = 1 << 18
PARTS = 1 << 16
#: First code points of script ranges, in order.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"),
    (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Japanese"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFF21, "Latin"), (0xFF5B, "Other"), (0xFF66, "Japanese"), (0xFFA0, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
_STARTS = [s for s, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Per code point: 0 for what is no letter, else 1 plus the number of the script's range."""
    starts = np.array(_STARTS)
    of = np.searchsorted(starts, np.arange(0x110000), side="right")
    names = {name: i for i, name in enumerate(dict.fromkeys(n for _, n in SCRIPTS), 1)}
    named = np.array([0, *(names[n] for _, n in SCRIPTS)], np.uint8)[of]
    named[[c for c in range(0x110000) if not chr(c).isalpha()]] = 0
    return named


SCRIPT_NAMES = ["", *dict.fromkeys(n for _, n in SCRIPTS)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_runs(points: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, script) of the words of lower-case text: runs of letters of one script, in pieces of at most ``PIECE``.

    ``fresh`` marks positions where no word goes on from before.
    """
    script = _letters()[points]
    new = np.ones(len(points), bool)
    new[1:] = script[1:] != script[:-1]
    if fresh is not None:
        new |= fresh
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(points))
    is_word = script[starts] > 0
    starts, ends = starts[is_word], ends[is_word]
    n = -(-(ends - starts) // PIECE)
    if len(n) and n.max() > 1:
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts, ends = np.repeat(starts, n) + nth * PIECE, np.repeat(ends, n)
        ends = np.minimum(ends, starts + PIECE)
    return starts, ends, script[starts]


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    lower = (text or "").lower()
    starts, ends, _ = word_runs(code_points(lower))
    return [lower[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def grams(word: str) -> list[str]:
    marked = f" {word} "
    n = len(marked)
    return [marked[i : i + k] for k in (1, 2, 3) for i in range(n - k + 1) if marked[i : i + k] != " "]


def packed(gram: str) -> int:
    """Up to three characters as a number; shorter grams have zeros in front."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    rows: dict[str, int]
    logs: np.ndarray  # a row per gram, the last for unknown grams
    scripts: dict[str, np.ndarray]  # which languages are seen in a script
    common: int = 0  # the language with most letters in the sample
    switch_penalty: float = 6.0

    def __post_init__(self) -> None:
        keys = np.array([packed(g) for g in self.rows], np.int64)
        order = np.argsort(keys)
        self._keys, self._rows = keys[order], np.array(list(self.rows.values()), np.int64)[order]
        allowed = [self.scripts.get(n, np.zeros(len(self.languages), bool)) for n in SCRIPT_NAMES]
        self._allowed = np.array(allowed, bool).reshape(len(SCRIPT_NAMES), len(self.languages))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def _sums(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``logs`` for packed grams."""
        if not len(self._keys):
            return np.repeat(self.logs[-1:], len(keys), 0)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return self.logs[np.where(self._keys[at] == keys, self._rows[at], len(self.logs) - 1)]

    def _scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        """Score of each word for each language, 0 for the best of those of its script; words of unknown scripts have zeros."""
        if not len(starts) or not self.languages:
            return np.zeros((len(starts), len(self.languages)), np.float32)
        sizes = ends - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        here = points[at].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        before, after = np.empty_like(here), np.empty_like(here)
        before[1:], after[:-1] = here[:-1], here[1:]
        before[first], after[first + sizes - 1] = 32, 32
        # Of each character: itself, with the one before, and with both neighbours; distinct triples are looked up once.
        keys, of = np.unique(before << 42 | here << 21 | after, return_inverse=True)
        a, b, c = keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF
        rows = self._sums(b) + self._sums(a << 21 | b) + self._sums(keys)
        closing = c == 32
        rows[closing] += self._sums(keys[closing] & (1 << 42) - 1)
        score = np.add.reduceat(rows[of], first, axis=0)
        allowed = self._allowed[scripts]
        best = np.where(allowed, score, -np.inf).max(1, keepdims=True)
        known = allowed.any(1)
        score = np.where(allowed, score - np.where(known[:, None], best, 0), np.float32(-1e4)).astype(np.float32)
        score[~known] = 0
        return score

    def label(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Labels of the words of each text (index of a language, -1 where the script is unknown) and their letters."""
        parts: list[tuple] = []
        counts: list[int] = []
        for n, part in self._scored(texts):
            counts.append(n)
            parts.append(part)
            if sum(counts) >= GROUP_WORDS:
                yield from self._label(counts, parts)
                parts, counts = [], []
        yield from self._label(counts, parts)

    def _scored(self, texts: list[str | None]) -> Iterator[tuple[int, tuple]]:
        """(words, (scores, script known, letters)) of every text, worked out ``SLICE`` characters at a time."""
        i = 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and (not group or size + len(texts[i] or "") <= SLICE):
                group.append((texts[i] or "").lower())
                size += len(group[-1])
                i += 1
            points = code_points("".join(group))
            edges = np.cumsum([0, *map(len, group)])
            fresh = np.zeros(len(points), bool)
            fresh[edges[:-1][edges[:-1] < len(points)]] = True
            starts, ends, scripts = word_runs(points, fresh)
            step = [0]
            while step[-1] < len(starts):
                step.append(max(step[-1] + 1, int(np.searchsorted(ends, starts[step[-1]] + SLICE, "right"))))
            scores = [self._scores(points, starts[x:y], ends[x:y], scripts[x:y]) for x, y in zip(step[:-1], step[1:], strict=True)]
            scores = np.concatenate(scores) if scores else np.zeros((0, len(self.languages)), np.float32)
            known, letters = self._allowed[scripts].any(1), ends - starts
            cuts = np.searchsorted(starts, edges)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield y - x, (scores[x:y], known[x:y], letters[x:y])

    def _label(self, counts: list[int], parts: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not counts:
            return
        scores, known, letters = (np.concatenate([p[k] for p in parts]) for k in range(3))
        sizes = np.array(counts, np.int64)
        starts = np.cumsum(sizes) - sizes
        labels = cut_viterbi(scores, starts, sizes, self.switch_penalty) if len(self.languages) else np.zeros(len(scores), np.int64)
        labels = np.where(known, labels, -1)
        for s, n in zip(starts.tolist(), counts, strict=True):
            yield labels[s : s + n], letters[s : s + n]

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for labels, letters in self.label(texts):
            total = int(letters.sum())
            if not total or not self.languages:
                yield "und", 0.0
                continue
            counts = np.bincount(labels[labels >= 0], letters[labels >= 0], minlength=len(self.languages))
            best = int(counts.argmax()) if counts.any() else self.common
            yield self.languages[best], float(counts[best] / total)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, first word, end word) of maximal runs of ``words_of``; words of unknown script join the run before."""
        out: list[list] = []
        for labels, _ in self.label([text]):
            for i, x in enumerate(labels):
                name = self.languages[x] if x >= 0 else out[-1][0] if out else "und"
                if out and out[-1][0] == name:
                    out[-1][2] = i + 1
                else:
                    out.append([name, i, i + 1])
        return [tuple(x) for x in out]


def cut_viterbi(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of sequences whose words are rows of ``table``, cut where a word decides.

    Before a word the best values of all labels lie within one penalty of each other; if the word favours
    one label by more than two, that label wins by more than a penalty whatever came before, and every
    label behind it is best reached from there. So the parts between such words, each with both of its
    ends, are decoded on their own.
    """
    top = np.partition(table, -2, axis=1) if table.shape[1] > 1 else np.column_stack([table - np.inf, table])
    first, last = np.zeros(len(table), bool), np.zeros(len(table), bool)
    some = sizes > 0
    first[starts[some]], last[(starts + sizes - 1)[some]] = True, True
    border = np.flatnonzero(first | last | (top[:, -1] - top[:, -2] > 2 * penalty))
    stop = np.where(last[border], border, np.append(border[1:], 0))
    whole = ~last[border] | first[border]  # the last word opens a part only if it is the sequence
    border, n = border[whole], (stop - border + 1)[whole]
    labels = np.zeros(len(table), np.int64)
    for lo in range(0, len(border), PARTS):
        a, k = border[lo : lo + PARTS], n[lo : lo + PARTS]
        flat = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        labels[flat] = viterbi(table, flat, np.cumsum(k) - k, k, penalty)
    return labels


def viterbi(table: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of many word sequences at once: per word its row of ``table``, per change of label the penalty."""
    labels = np.zeros(len(flat), np.int64)
    order = np.argsort(-sizes, kind="stable")
    start, size = starts[order], sizes[order]
    if not len(size) or not size[0]:
        return labels
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    kind = np.min_scalar_type(table.shape[1])
    back = np.zeros((len(flat), table.shape[1]), kind)
    own = np.arange(table.shape[1], dtype=kind)
    value = table[flat[start[: active[0]]]]
    final = np.zeros((len(size), table.shape[1]), np.float32)
    for t in range(1, longest):
        n = int(active[t])
        if n < len(value):
            final[n : len(value)] = value[n:]
            value = value[:n]
        best = value.argmax(1)
        top = value.max(1) - penalty
        stay = value >= top[:, None]
        at = start[:n] + t
        back[at] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, top[:, None]) + table[flat[at]]
    final[: len(value)] = value
    state = final.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = int(active[t])
        at = start[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            words[lang.as_py()].update(words_of(text.as_py()))
    for lang, counts in words.items():
        out: Counter = Counter()
        for word, n in counts.items():
            out["script:" + script_of(word[0])] += n * len(word)
            for g in grams(word):
                out[g] += n
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(list(out), pa.string()), pa.array(out.values(), pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, sample_docs: int = 6000, max_grams: int = 30_000, held_out_fold: int | None = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from about ``sample_docs`` rows with a language whose fold is not the held-out one.

    Every language has an equal share of the sample, as far as it has rows; what rare ones leave goes to the others.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
    if held_out_fold is not None:
        rows = rows.filter(fold(F.col("id")) != held_out_fold)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    left, want = sample_docs, {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        want[lang] = min(n, left // (len(sizes) - i))
        left -= want[lang]
    share = F.create_map(*[F.lit(x) for k, n in want.items() for x in (k, min(int(n / sizes[k] * (1 << 62)) * 2, (1 << 63) - 1))]) if want else None
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 1) <= F.element_at(share, F.col("lang"))) if want else rows
    counts = sample.select("text", "lang").mapInArrow(giving_back(_gram_counts), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    is_script = F.startswith("gram", F.lit("script:"))
    wide = wide.orderBy(is_script.desc(), F.col("total").desc(), "gram")
    found = wide.limit(max_grams + len(SCRIPT_NAMES)).collect()
    languages = sorted({k for r in found for k in r["by"]})
    seen = {r["gram"].removeprefix("script:"): r["by"] for r in found if r["gram"].startswith("script:")}
    found = [r for r in found if not r["gram"].startswith("script:")][:max_grams]
    table = np.array([[r["by"].get(k, 0) for k in languages] for r in found] + [[0] * len(languages)], np.float64).reshape(len(found) + 1, len(languages))
    logs = np.log(table + smoothing) - np.log(table.sum(0) + smoothing * len(table))
    logs[-1] = math.log(smoothing) - math.log(table.sum() + 1) if len(table) else 0.0
    letters = {k: sum(by.get(k, 0) for by in seen.values()) for k in languages}
    scripts = {s: np.array([by.get(k, 0) >= 0.01 * letters[k] > 0 for k in languages], bool) for s, by in seen.items()}
    common = max(range(len(languages)), key=lambda i: letters[languages[i]], default=0)
    return LanguageModel(languages, {r["gram"]: i for i, r in enumerate(found)}, logs.astype(np.float32), {s: a for s, a in scripts.items() if a.any()}, common)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document; score is the share of letters in spans of lang_pred."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.predict(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(giving_back(run), f"id {source.dtypes[0][1]}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """Documents whose language is known and covers ``min_score`` of their letters; columns as they came."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x != "und" and s >= min_score for x, s in shared.value.predict(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
