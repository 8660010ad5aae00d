"""Line-first cleaning: rules per line, failing lines go, documents that lose too much text go.

A line fails when it looks like navigation (many separators), breaks a punctuation rule
(shouting marks after most words, a stub without an end mark, or a long line without any mark), is
boilerplate (a notice in a line of moderate length, a prompt in a short one; phrases of four languages between
word borders), or repeats an earlier line of its document. A document is rejected when less than ``min_kept`` of the
characters in its words is left, or when it fails the base rules (too few words, or too many
words inside repeated 3-word windows).

Rows are independent, so this is one narrow pass in Arrow batches; nothing is shuffled.

Defined results: null, empty and blank texts have no words, fail the base rules and are not
kept; text of any length is processed whole (memory in proportion to one text); repeated rows
give repeated results; an empty table gives none; other columns are passed through by
``clean_documents`` and not read by ``quality_report``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.workers import giving_back

#: Characters counted as symbols, marks that end a sentence, separators of menus.
SYMBOLS = "#*$%&|<>"
END_MARKS = tuple(".!?…\"'”’»)]:;。！？")
SEPARATORS = re.compile(r"(?:^|[ \t])[|»›>·•](?=[ \t]|$)")
SHOUTS = re.compile(r"[!?*#%&]{2,}")
ANY_MARK = re.compile("[.!?…,;:。！？，；：、]")
#: Legal and technical notices, and prompts of web pages, in four languages.
NOTICES = [
    "all rights reserved", "terms of (?:use|service)", "privacy policy", "cookie policy", "enable javascript", "lorem ipsum", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "javascript aktivieren",
    "tous droits réservés", "conditions d['’]utilisation", "politique de confidentialité", "mentions légales", "activer javascript",
    "todos los derechos reservados", "términos (?:de uso|del servicio)", "política de privacidad", "aviso legal", "activar javascript",
]
PROMPTS = [
    "accept (?:all )?cookies", "click here", "subscribe to our", "sign up", "log in", "read more",
    "cookies akzeptieren", "hier klicken", "newsletter abonnieren", "jetzt registrieren", "einloggen", "mehr lesen",
    "accepter les cookies", "cliquez ici", "abonnez-vous", "se connecter", "lire la suite",
    "aceptar (?:las )?cookies", "haga clic aquí", "suscríbase", "iniciar sesión", "leer más",
]


def _phrases(names: list[str]) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?:{'|'.join(names)})(?!\w)", re.IGNORECASE)


NOTICE, PROMPT = _phrases(NOTICES), _phrases(PROMPTS)
BLANK = str.maketrans("", "", " \t\n\r\x0b\x0c")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    stub_words: int = 4
    separator_share: float = 0.25
    shout_share: float = 0.3
    flat_words: int = 30
    notice_words: int = 25
    prompt_words: int = 8
    min_kept: float = 0.5


def words_of(text: str) -> list[bytes]:
    """Runs of other characters than space and \\x09-\\x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in 3-word windows found twice or more. Windows get exact integer names."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    n = len(names)
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    if len(counts) == len(at):
        return 0
    twice = counts[at] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(twice)] |= twice
    return int(inside.sum())


def line_fails(line: str, n_words: int, rules: Rules) -> bool:
    """The line's own rules; ``n_words`` is at least 1."""
    if len(SEPARATORS.findall(line)) >= max(2, rules.separator_share * n_words):
        return True
    if n_words >= 3 and len(SHOUTS.findall(line)) > rules.shout_share * n_words:
        return True
    if n_words <= rules.stub_words and not line.rstrip().endswith(END_MARKS):
        return True
    if n_words >= rules.flat_words and ANY_MARK.search(line) is None:
        return True
    if n_words <= rules.prompt_words and PROMPT.search(line) is not None:
        return True
    return n_words <= rules.notice_words and NOTICE.search(line) is not None


def assess(text: str | None, rules: Rules) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text without failed lines."""
    text = text or ""
    words = words_of(text)
    n_words, word_chars = len(words), len(text.translate(BLANK))
    seen: set[str] = set()
    duplicates, left, good = 0, 0, []
    for line in text.split("\n"):
        n = len(words_of(line))
        if not n:
            good.append(line)
        elif line in seen:
            duplicates += 1
        else:
            seen.add(line)
            if not line_fails(line, n, rules):
                good.append(line)
                left += len(line.translate(BLANK))
    repeats = repeated_words(words)
    failed = n_words < rules.min_words or 100 * repeats > rules.max_repeat_percent * n_words
    kept = not failed and left >= rules.min_kept * word_chars
    return n_words, word_chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, failed, kept, "\n".join(good)


STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
_NAMES = [x.split()[0] for x in STATS.split(", ")]
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2


def quality_report(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, STATS) of every document; ``with_text`` adds ``clean_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [assess(t.as_py(), rules) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=False))]
            if with_text:
                arrays.append(pa.array(columns[7], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["id", *_NAMES, *["clean_text"] * with_text])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(giving_back(run), f"id {source.dtypes[0][1]}, {STATS}{', clean_text string' if with_text else ''}")
    return out.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """Kept documents with failed lines removed; all columns of ``docs`` stay, in their order."""
    names, at = docs.columns, docs.columns.index(text_col)
    kept_at = _NAMES.index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [assess(t.as_py(), rules) for t in batch.column(at)]
            keep = pa.array([r[kept_at] for r in rows], pa.bool_())
            out = batch.set_column(at, batch.schema.field(at), pa.array([r[7] for r in rows], batch.schema.field(at).type))
            yield out.filter(keep)

    out = docs.mapInArrow(giving_back(run), docs.schema)
    return out.withColumn(n_chars_col, F.length(text_col).cast("long")) if n_chars_col in names else out
