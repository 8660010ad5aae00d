"""License scan by diagonal voting over rolling word hashes.

Every text gives the hashes of all its word pairs and of all its five-word runs. They meet the same hashes of
the templates' positions in one broadcast join (the templates are a fixed list, of about 700 positions by default, and their
number is checked), and each meeting is proved by the words themselves while the text is still at hand, so texts are
never shuffled. A meeting votes for the diagonal (text position less template position) of its
template in its text. Neighbouring diagonals of one template, which a few inserted or left out words part, are merged into a
span; a span is verified when it covers enough of its template, and is not stretched over much else.

Templates of up to eight words (phrases) are matched by word pairs and must be whole; longer ones are matched by five-word runs
and need ``share`` of their words. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

Defined results: null and empty texts have no words and no spans; every row gives one row, repeated
rows give equal rows; null ids stay; a text's spans are dealt by (id, MD5 of the text), so neither
copies nor sources meet in one task; work columns are named ``_ls_*`` and only the id and the text are read, so other
columns cannot clash; an empty table gives no rows; a long text is held as one array of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR, RUN = 2, 5
PHRASE_WORDS = 8
#: Most template positions that may be broadcast.
MOST_POSITIONS = 20_000
#: Words between neighbouring votes, and words by which their diagonals may differ, in one span.
GAP, SHIFT = 12, 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    share: float = 0.6
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Wordings of public licenses, in lower case and without punctuation.
TEMPLATES = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("cc", "licensed under cc by"),
    Template("cc", "creative commons attribution"),
    Template("cc", "creative commons license"),
    Template("bsd", "bsd license"),
    Template("bsd", "2 clause bsd"),
    Template("bsd", "3 clause bsd"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("mit", "spdx license identifier mit"),
    Template("apache", "spdx license identifier apache"),
    Template("gpl", "spdx license identifier gpl"),
    Template("bsd", "spdx license identifier bsd"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law "
        "or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
    ),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]


def width(t: Template) -> int:
    return PAIR if len(t.words) <= PHRASE_WORDS else RUN


def lower_case(text: Column) -> Column:
    """A-Z in lower case. The Kelvin sign, the one other letter whose small form is an ASCII word, is another letter of the same kind."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_case(text), SEPARATORS), "")


def positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(gram, width, template, at, words) of every template position, and one row of width 0 that every text meets once."""
    rows = [(0, -1, 0, [])]
    for i, t in enumerate(templates):
        if len(t.words) < PAIR:
            raise ValueError(f"a template needs {PAIR} words: {t.text!r}")
        rows += [(width(t), i, at, t.words[at : at + width(t)]) for at in range(len(t.words) - width(t) + 1)]
    if len(rows) > MOST_POSITIONS:
        raise ValueError(f"{len(rows)} template positions; at most {MOST_POSITIONS} are broadcast")
    p = spark.createDataFrame(rows, "_ls_tw int, _ls_t int, _ls_at int, _ls_tws array<string>")
    gram = F.when(F.col("_ls_tw") == RUN, _gram(_hashes("_ls_tws"), 0, RUN)).otherwise(_gram(_hashes("_ls_tws"), 0, PAIR))
    return p.withColumn("_ls_tg", F.when(F.col("_ls_tw") == 0, F.lit(0)).otherwise(gram))


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(hashes: Column, at: Column | int, n: int) -> Column:
    return F.xxhash64(*[F.get(hashes, F.lit(at) + k if isinstance(at, int) else at + k) for k in range(n)])


def _hits(docs: DataFrame, templates: list[Template], id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_words, template, at, pos): proved meetings of a text's grams with template positions, and one row of template -1."""
    d = docs.select(F.col(id_col).alias("_ls_id"), F.md5(text_col).alias("_ls_key"), words(F.col(text_col)).alias("_ls_words"))
    d = d.withColumn("_ls_h", _hashes("_ls_words"))
    h, n = F.col("_ls_h"), F.size("_ls_words")
    rolling = lambda k: F.transform(h, lambda x, i: _gram(h, i, k))
    d = d.withColumn("_ls_grams", F.concat(F.array(F.lit(0).cast("long")), rolling(PAIR), rolling(RUN)))
    # Outer, or Spark would push a test of the array down to the scan and make the grams anew for every word.
    d = d.select("_ls_id", "_ls_key", "_ls_words", n.alias("_ls_n"), F.posexplode_outer("_ls_grams").alias("_ls_p", "_ls_g"))
    p = F.col("_ls_p") - 1
    d = d.withColumns({"_ls_w": F.when(p < 0, 0).when(p < F.col("_ls_n"), PAIR).otherwise(RUN), "_ls_pos": F.when(p < 0, 0).when(p < F.col("_ls_n"), p).otherwise(p - F.col("_ls_n"))})
    t = F.broadcast(positions(docs.sparkSession, templates))
    same = (F.col("_ls_g") == F.col("_ls_tg")) & (F.col("_ls_w") == F.col("_ls_tw")) & (F.slice("_ls_words", F.col("_ls_pos") + 1, F.col("_ls_tw")) == F.col("_ls_tws"))
    return d.join(t, same).select("_ls_id", "_ls_key", "_ls_n", "_ls_t", "_ls_at", "_ls_pos")


def _of(template: Column, values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), template + 1)


def license_spans(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans) of every row; spans are of (label, base, first_word, n_words, coverage), in order of place."""
    t = F.col("_ls_t")
    exact = _of(t, [len(x.words) <= PHRASE_WORDS for x in templates], "boolean")
    text = ["_ls_id", "_ls_key", "_ls_n"]
    hits = _hits(docs, templates, id_col, text_col).repartition("_ls_id", "_ls_key")
    votes = hits.groupBy(*text, "_ls_t", (F.col("_ls_pos") - F.col("_ls_at")).alias("_ls_diag"))
    votes = votes.agg(F.collect_set("_ls_at").alias("_ls_ats"), F.min("_ls_pos").alias("_ls_first"), F.max("_ls_pos").alias("_ls_last"), F.count(F.lit(1)).alias("_ls_rows"))
    line = Window.partitionBy(*text, "_ls_t").orderBy("_ls_first", "_ls_diag")
    near = (F.col("_ls_first") - F.max("_ls_last").over(line.rowsBetween(Window.unboundedPreceding, -1)) <= GAP) & (F.abs(F.col("_ls_diag") - F.lag("_ls_diag").over(line)) <= SHIFT)
    votes = votes.withColumn("_ls_new", F.when((t >= 0) & ~exact & F.coalesce(near, F.lit(False)), 0).otherwise(1))
    votes = votes.withColumn("_ls_place", F.sum("_ls_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    w = _of(t, [width(x) for x in templates], "int")
    spans = votes.groupBy(*text, "_ls_t", "_ls_place").agg(
        F.array_distinct(F.flatten(F.collect_list("_ls_ats"))).alias("_ls_ats"), F.min("_ls_first").alias("_ls_first"), F.max("_ls_last").alias("_ls_last"), F.sum("_ls_rows").alias("_ls_rows")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("_ls_ats", lambda a: F.sequence(a, a + w - 1)))))
    spans = spans.withColumn("_ls_words", F.when(t >= 0, F.col("_ls_last") - F.col("_ls_first") + w)).withColumn("_ls_cover", F.when(t >= 0, covered))
    whole = _of(t, [len(x.words) for x in templates], "int")
    share = _of(t, [1.0 if len(x.words) <= PHRASE_WORDS else x.share for x in templates], "double")
    fine = (F.col("_ls_cover") >= share * whole) & (F.col("_ls_cover") >= share * F.col("_ls_words"))
    span = F.struct(
        F.col("_ls_first").cast("long").alias("first_word"), F.col("_ls_words").cast("long").alias("n_words"), _of(t, [x.label for x in templates], "string").alias("label"),
        _of(t, [x.base for x in templates], "boolean").alias("base"), (F.col("_ls_cover") / whole).alias("coverage"),
    )
    out = spans.groupBy(*text).agg(F.sum(F.when(t < 0, F.col("_ls_rows"))).alias("_ls_rows"), F.array_sort(F.collect_list(F.when((t >= 0) & fine, span))).alias("spans"))
    out = out.select(F.col("_ls_id").alias(id_col), F.col("_ls_n").cast("long").alias("n_words"), "spans", F.explode(F.sequence(F.lit(1), "_ls_rows")).alias("_ls_copy"))
    return out.drop("_ls_copy")


def license_report(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest coverage of a verified span, else 0)."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first_word"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return license_spans(docs, templates, id_col, text_col).select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(s).alias("labels"), F.coalesce(F.array_max(F.transform(s, lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )
