"""License scan, token alignment and filter audit against brute force, libraries and edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import filter_audit, license_scan, queries, token_alignment
from tests.compare import differences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
NOTICE = next(t for t in license_scan.TEMPLATES if t.text.startswith("this program is free")).text
TEXTS = [
    (1, None, "a"), (2, "", None), (3, "  \n", ""), (4, "MIT License, mit-license; the MIT  license.", "a"), (5, "MIT License, mit-license; the MIT  license.", "b"),
    (None, "no id: General Public License", None), (None, "no id: General Public License", None), (6, "mitK license MIT LiKense", "a"), (7, "gnu General PUBLIC license v3 apache License", "a"),
    (8, "x " + NOTICE.replace("redistribute it and", "redistribute it (as you like it) and").replace("as published", "published"), "b"), (9, "word " * 30_000 + "apache license", "a"),
    (9, "word " * 30_000 + "apache license", "a"), (10, "▁ " + "é漢😀<|endoftext|></s>", "a"), (11, "Ünïcode é 漢字 😀 <|endoftext|> <s> tail", "c"), (12, "A B $ C", "a"), (13, "same same", "b"), (4, "another text of id four", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(TEXTS, DOCS)
    return d.withColumns({c: F.lit(1) for c in ("n_words", "spans", "mask", "part", "n_a", "words", "label", "step")}).repartition(3)


@pytest.mark.parametrize("name", ["op11_license_diagonals", "op13_filter_audit"])
def test_equal_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == []


# ---- 11: license scan -------------------------------------------------------------


def base_places(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, t.label) for t in license_scan.TEMPLATES if t.base for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in at}))


def test_base_places_are_those_of_a_plain_scan(docs):
    got = license_scan.license_report(docs).collect()
    want = Counter((i, *base_places(t)) for i, t, _ in TEXTS)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_span_over_neighbouring_diagonals(spark):
    cut = NOTICE.replace("redistribute it and", "redistribute it as you like it and").replace("as published", "published")
    half = " ".join(NOTICE.split()[:20])
    d = spark.createDataFrame([(1, f"before {cut} after"), (2, half), (3, half + " filler" * 200 + " " + " ".join(NOTICE.split()[20:]))], "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if s["n_words"] > 20 and s["label"] == "gpl"] for r in license_scan.license_spans(d).collect()}
    assert len(got[1]) == 1 and got[1][0]["first_word"] == 1 and got[1][0]["n_words"] == len(cut.split()) and 0.8 < got[1][0]["coverage"] < 1
    assert got[2] == []  # less than the share
    assert got[3] == []  # the parts are too far from one another


def test_no_python_and_no_shuffled_text(spark, docs):
    plan = license_scan.license_report(docs)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan
    exchanged = plan.split("== Physical Plan ==")[1]
    assert all("text" not in line for line in exchanged.splitlines() if "REPARTITION_BY_COL" in line)


def test_too_many_templates_are_refused(spark, docs):
    with pytest.raises(ValueError, match="broadcast"):
        license_scan.positions(spark, [license_scan.Template("x", "a b " * 20_000)])


def test_license_scan_of_an_empty_table(docs):
    assert license_scan.license_report(docs.filter("false")).count() == 0


# ---- 12: token alignment ----------------------------------------------------------


def brute_alignment(rows: list[tuple[int, str | None]]) -> list[tuple]:
    import public_tokenizers as P

    t = token_alignment.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    counts: Counter = Counter()
    found = []
    for i, text in rows:
        a, b = t.a.encode(" " + text, add_special_tokens=False).ids if text else [], t.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(t.a_bytes[x] for x in a) != want or b"".join(t.b_bytes[x] for x in b) != want:
            a, b = [], []
        ends = lambda ids, of: list(np.cumsum([len(of[x]) for x in ids]))
        ea, eb = ends(a, t.a_bytes), ends(b, t.b_bytes)
        links, k = [], 0
        for x, end in enumerate(ea):
            start = end - len(t.a_bytes[a[x]])
            while k < len(b) and eb[k] <= start:
                k += 1
            j = k
            while j < len(b) and eb[j] - len(t.b_bytes[b[j]]) < end:
                links.append((a[x], b[j]))
                j += 1
        counts.update(links)
        groups, la, lb = [], 0, 0
        for both in sorted(set(ea) & set(eb)):
            x, y = ea.index(both) + 1, eb.index(both) + 1
            groups.append(",".join(map(str, a[la:x])) + "|" + ",".join(map(str, b[lb:y])))
            la, lb = x, y
        found.append((i, len(a), len(b), groups, links))
    most: dict = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, na, nb, len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), digest(g)) for i, na, nb, g, ls in found]


def aligned(df) -> Counter:
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_equals_a_plain_walk(spark, docs):
    short = [(i, t if t is None or len(t) < 1000 else t[-2000:]) for i, t, _ in TEXTS]
    d = spark.createDataFrame(short, "doc_id long, text string").withColumn("n_a", F.lit("x")).repartition(3)
    want = brute_alignment(short)
    assert aligned(token_alignment.align(d)) == Counter(want)
    assert any(r[1] == 0 and r[0] == 10 for r in want) and any(r[1] > 0 and r[0] == 11 for r in want)


def test_alignment_of_documents_with_small_runs_and_salts(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    want = Counter(brute_alignment([(r.doc_id, r.text) for r in d.collect()]))
    assert aligned(token_alignment.align(d)) == want
    monkeypatch.setattr(token_alignment, "PACK_BYTES", 4_000)  # many salts
    assert aligned(token_alignment.align(d)) == want


def test_alignment_of_an_empty_table_and_of_no_texts(spark):
    d = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert aligned(token_alignment.align(d.filter("false"))) == Counter()
    assert aligned(token_alignment.align(d)) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])


def test_overlaps_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = rng.integers(1, 6, rng.integers(1, 30))
        b = rng.integers(1, 6, 40)
        b = b[: np.searchsorted(np.cumsum(b), a.sum())]
        b = np.append(b, a.sum() - b.sum())
        first, end, border = token_alignment.overlaps(a, b)
        ea, eb = np.cumsum(a), np.cumsum(b)
        for i in range(len(a)):
            hit = [j for j in range(len(b)) if eb[j] - b[j] < ea[i] and eb[j] > ea[i] - a[i]]
            assert (first[i], end[i]) == (hit[0], hit[-1] + 1)
        assert list(np.flatnonzero(border)) == [j for j in range(len(b)) if eb[j] - b[j] in {0, *ea}]


# ---- 13: filter audit -------------------------------------------------------------


def brute_audit(rows: list[tuple], labels: dict) -> dict:
    out: dict = defaultdict(lambda: [0] * 7)
    parts: dict = defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        parts[source or ""].append((fails, labels.get(i, (0, 0))))
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                row = out[part, order, step]
                for fails, (good, toxic) in members:
                    gone = any(fails[f] for f in order[: step - 1])
                    row[0] += not gone and not fails[own]
                    row[1] += not gone and fails[own]
                    row[2] += gone and fails[own]
                    row[3] += fails[own] and sum(fails.values()) == 1
                    row[4] += not gone and fails[own] and good == 1
                    row[5] += not gone and fails[own] and toxic == 1
        for own in "ABCDE":
            total = sum(out[part, o, o.index(own) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(own) + 1][6] = total
    return out


def test_audit_equals_brute_force_on_edge_rows(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (9, 1, None), (5, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    clean = docs.drop("part").withColumn("mask", F.lit(3))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.filter_audit(clean, labels).collect()}
    assert got == dict(brute_audit(TEXTS, {4: (1, 1), 9: (1, 0), 5: (0, 1)}))
    assert filter_audit.filter_audit(clean.filter("false"), labels).count() == 0


def test_audit_moves_no_text(docs, spark):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    plan = filter_audit.filter_audit(docs.drop("part"), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_both_ways_of_encoding_give_the_same_ids(spark):
    import public_tokenizers as P

    t = token_alignment.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    odd = ["a" * 20_000, " \n\t \r\n  x  y ", "it's WE'LL o'Clock 'S", "é" * 3000, "\x00\x1c\x85 <|endoftext|>", "1234 5 67!!!???", "ͰͿ ҈ ԯ"]
    texts = [" " + x for x in [*odd, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]]]
    assert t.ranked is not None and t.encode_a(texts) == [e.ids for e in t.a.encode_batch_fast(texts, add_special_tokens=False)]
