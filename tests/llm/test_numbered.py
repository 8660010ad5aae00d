"""The numbered operators against brute force, libraries and edge cases."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import hamming_search, language, mixing, near_dedup, quality, queries, quotes, sentencepiece, sharding, token_count, warc
from tests.compare import differences

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
TEXTS = [None, "", "   \n\t", "one", "a b c d", "same text here for all of you", "same text here for all of you", "Ünïcode é 漢字 😀 ▁ <|endoftext|>", LONG]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no id at all", None, None, None), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("block", "size", "node", "key", "shard", "ids", "body")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 1: mixing --------------------------------------------------------------------


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * won[j] + 1), -j))
        won[i] += 1
    return won


def test_quotas_are_sainte_lague(spark):
    votes = [1000.0, 340.0, 77.0, 5.0, 0.0, 341.0]
    t = spark.createDataFrame([(f"s{i}", 500, v, i + 1) for i, v in enumerate(votes)], "k string, source_size long, target double, rank int")
    got = {r.k: r for r in mixing.shard_quotas(t, block_words=10, n_shards=4, blocks_per_source=1).collect()}
    for shard in range(4):
        seats = math.floor(round(sum(votes) / 10) * (shard + 1) / 4)
        assert [got[f"s{i}"].cum[shard] for i in range(len(votes))] == sainte_lague(votes, seats)


def brute_targets(sizes: list[int], weights: list[int]) -> list[float]:
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = sum(sizes) - sum(target[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        for i in over or free:
            target[i] = float(3 * sizes[i]) if over else share[i]
        free = free - set(over) if over else set()
    return target


def test_targets(spark):
    sizes = [5, 1000, 10, 70, 900, 3]
    t = spark.createDataFrame([(f"s{i}", f"s{i}", n) for i, n in enumerate(sizes)], "k string, source string, source_size long")
    got = [r.target for r in mixing.source_targets(t).orderBy("rank").collect()]
    assert got == pytest.approx(brute_targets(sizes, [1, 2, 3, 1, 2, 3]))


def test_mix(spark, docs):
    found = mixing.mix(docs).cache()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    rows = found.collect()
    assert {r.doc_id: r["size"] for r in rows} == words
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("block").alias("block")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target + 3 * r.block
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()} == {r.doc_id: r.taken for r in rows}


def test_mix_edges(edge):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(edge.limit(0)).count() == 0
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns and out.filter("doc_id = 0").count() == 0


# ---- 2: quotations ----------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "Hello there my good friend\nSecond line of the message here"),
        (1, 1, "> Hello  there my GOOD friend\n> Second line of the message here\nMy answer is forty two"),
        (1, 2, "Bob wrote on Monday:\n>> Hello there my good friend\n> My answer is forty two\nThanks a lot"),
        (1, 3, "unrelated"),
        (1, 4, "> second line of the message here\nonly a line"),
        (1, 5, None),
        (1, 5, None),
        (None, 0, ""),
        (1, None, "> unrelated"),
        (2, 0, "> Hello there my good friend"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("body", F.lit("clash"))
    got = quotes.build_conversations(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].parent_turn, by[1, 1].body) == (0, "My answer is forty two")
    assert (by[1, 2].parent_turn, by[1, 2].quote_depth, by[1, 2].reply_depth, by[1, 2].root_turn, by[1, 2].body) == (1, 2, 2, 0, "Thanks a lot")
    assert by[1, 4].parent_turn == 0 and by[2, 0].n_linked == 0
    assert sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2, 3, 4, 5, 5, 6]
    assert all(by[1, r.parent_turn].position < r.position for r in got if r.parent_turn is not None)
    assert quotes.build_conversations(df.limit(0)).count() == 0


def test_short_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "We should meet soon to talk it over\nFriday at 5?\nBest"),
        (1, 1, "> Friday at 5?\nyes"),
        (1, 2, "A long first paragraph that a mail\nprogram has wrapped\n\nAnd another paragraph of it here"),
        (1, 3, "> A long first paragraph that\n> a mail program\n> has wrapped\n>\n> And another paragraph\n> of it here\nall of it"),
        (1, 4, "> A long first\n> paragraph that a mail program has wrapped\nonly that"),
        (1, 5, "> Friday at 5?\n> Best\nboth"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    assert {r.turn: r.parent_turn for r in quotes.build_conversations(df).collect()} == {0: None, 1: 0, 2: None, 3: 2, 4: 2, 5: 0}


def quoted_conversations(n: int = 400) -> list[tuple]:
    """Conversations that quote each other: nested, partly, re-wrapped, tied, repeated and very long quotes."""
    rng = np.random.default_rng(14)
    said: dict[int, list[str]] = {}
    rows = []
    for i in range(n):
        conv = int(rng.choice([0, 0, 0, 1, 2, 3]))
        before = said.setdefault(conv, [])
        text = "\n".join(" ".join(f"word{rng.integers(60)}" for _ in range(rng.integers(1, 9))) + rng.choice(["", ".", "?", "\n"]) for _ in range(rng.integers(1, 5)))
        if before and rng.random() < 0.7:
            source = before[rng.integers(len(before))].split("\n")
            part = source[rng.integers(len(source)) :] if rng.random() < 0.5 else source
            if rng.random() < 0.3:
                part = " ".join(part).split()
                part = [" ".join(part[k : k + 4]) for k in range(0, len(part), 4)] or [""]
            mark = rng.choice([">", "> ", ">> ", " > "])
            text = rng.choice(["", "On Monday Ann wrote:\n"]) + "\n".join(mark + x for x in part) + rng.choice(["\n", "\r\n"]) + text
        before.append(text)
        rows.append((conv, len(before) - 1, "user", text))
    long = "\n".join(f"line {k} of a very long message" for k in range(3000))
    extra = [(4, 0, "user", long), (4, 1, "user", "\n".join("> " + x for x in long.split("\n"))), (4, 2, "user", "> line 5 of a very long message\nthat one"), (4, 3, "user", None), (5, 0, "a", ""), (5, 1, "a", "same"), (5, 1, "a", "same"), (5, 2, "a", "> same"), (5, 2, "a", "> same")]
    return rows + extra


def test_quotes_equal_sql(spark, tmp_path):
    """The registered query and its SQL over conversations that do quote."""
    rows = quoted_conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/made/*.parquet'")
    rel = con.sql(queries.ORACLES["op2_quotation_links"])
    spark.read.parquet(str(tmp_path / "made")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op2_quotation_links(spark, str(tmp_path))
    want = sorted(map(str, rel.select(", ".join(got.columns)).fetchall()))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert got.filter("n_linked > 0").count() > 150 and got.filter("reply_depth > 2").count() > 10


def test_quotes_are_native(spark, docs):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = quotes.build_conversations(df)._jdf.queryExecution().executedPlan().toString() + quotes.parse(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 3: token counts --------------------------------------------------------------


def test_token_counts(spark, docs, edge):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.public_tokenizers.path("word_bpe_49k.json"))
    for df in (docs, edge):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        want = collections.Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in rows)
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(df).collect()) == want


# ---- 4: near duplicates -----------------------------------------------------------


def brute_classes(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = {}
    for i, t in rows:
        w = t.encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [1, 3, 512])
def test_mixed_buckets(spark, block, monkeypatch):
    """A chain of texts, each close to the next only, is one class although no centre is close to all."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[i * 12 : i * 12 + 200]) for i in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_hot_bucket(spark, monkeypatch):
    """Many near copies of one text, stragglers near to each other or to one copy only, in few small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]

    def changed(words, n):
        words = list(words)
        for at in rng.integers(0, len(words), n):
            words[at] = f"x{rng.integers(1 << 30)}"
        return words

    copies = [changed(base, 1) for _ in range(60)]
    odd = [changed(copies[i], 3) for i in range(10)] + [changed(base, 12) for _ in range(5)]
    rows = list(enumerate(" ".join(w) for w in copies + odd + [changed(odd[-1], 1)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == brute_classes(rows)


def test_candidates_miss_no_similar_set():
    rng = np.random.default_rng(12)
    pool = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(150)]
    found = dict(near_dedup.candidates(sets, sets, 0.8))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if near_dedup._alike(a, b, 0.8):
                assert j in found[i]


def test_counted_windows(spark):
    """Weighted similarity: a text and itself pasted twice are apart, a text with one repeated line is close."""
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(0, text), (1, text + " " + text), (2, text + " " + " ".join(f"w{i}" for i in range(20)))], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, near_dedup.Banding(counted=True))
    assert {r.doc_id: r.class_id for r in got.collect()} == {0: 0, 1: 1, 2: 0}


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.9: nine in ten at least are linked (all but 7e-5 are expected)."""
    rng = np.random.default_rng(21)
    rows, close = [], 0
    for k in range(150):
        a = [f"p{k}w{i}" for i in range(200)]
        b = list(a)
        for at in rng.integers(0, 200, 4):
            b[at] = "y" + b[at]
        sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (a, b)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.9:
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
            close += 1
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert close > 50 and got.filter("doc_id % 2 = 1 and class_id = doc_id - 1").count() >= 0.9 * close


def test_repeated_texts_are_candidates(spark):
    """Sets of windows say nothing of how often a window is found, so a text is alike to itself pasted several times."""
    texts = [" ".join([" ".join(f"t{k}w{i}" for i in range(200))] * times) for k in range(3) for times in (1, 2, 3, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(list(enumerate(texts))) and set(got.values()) == {0, 4, 8}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 4, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    docs = np.repeat([0, 1], 300)
    sig = near_dedup.dart_signatures(docs, np.tile(elements, 2), np.concatenate([a, b]), 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_near_duplicate_edges(edge):
    rows = near_dedup.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[6] == {5} and by[5] == {5} and by[0] == {0} and by[4] == {4}
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id in (5, 6)").count() == 1 and kept.filter("doc_id = 4").count() == 1
    assert near_dedup.near_duplicates(edge.limit(0)).count() == 0


# ---- 5: quality -------------------------------------------------------------------


def test_base_numbers(docs):
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for d in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text)
        counts = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in d.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(d.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and (not r.kept or not r.base_failed)


def test_line_rules():
    rules = quality.Rules()
    fails = lambda t: quality.line_fails(t, len(t.split()), rules)
    assert fails("Home | About | Contact | Help") and fails("BUY!! NOW!! CHEAP!!") and fails("Read more") and fails("All rights reserved by us.")
    assert fails("Tous droits réservés par nous.") and fails("Bitte hier klicken!") and fails("word " * 40)
    assert not fails("He keeps a dialog into which the design uploads go.") and not fails("My blog in that catalog in short.")
    assert not fails("To take part you sign up at the desk beside the door and wait.") and not fails("word " * 39 + "end.")
    assert not fails("A plain sentence that ends well.") and not fails("A long line that was cut in the middle of")


def test_clean_documents_edges(edge):
    out = quality.clean_documents(edge)
    assert out.columns == edge.columns and quality.quality_report(edge).filter("kept").count() == out.count()
    assert quality.quality_report(edge.limit(0)).count() == 0


# ---- 6: nearest neighbours --------------------------------------------------------


def test_search_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in hamming_search.nearest(v, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = v.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hits = n = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {i for i, _ in got[q]})
        n += 20
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits / n >= 0.9


def test_clustered_vectors_are_pruned(spark):
    """Of vectors in clusters a small part is probed, from a sample that holds fewer than k of a cluster, too; neighbours are right."""
    rng = np.random.default_rng(2)
    n, centres = 6_000, rng.normal(size=(100, 64))
    x = centres[np.arange(n) % 100] / np.linalg.norm(centres, axis=1)[np.arange(n) % 100, None] + 0.2 * rng.normal(size=(n, 64)) / 8
    norm = float(np.sqrt((x * x).sum(1)).max())
    sample = rng.random(n) < 0.2  # some 12 of a cluster's 60
    codes = hamming_search.learn(x[sample], norm, share=0.2)
    index, asked = codes.encode(x, False), codes.encode(x[::20], True)
    tables = hamming_search.MultiIndex(index, codes.radius)
    probed = [np.bitwise_count(np.bitwise_or.reduce(tables.tables[np.arange(len(c)), c], axis=0)).sum() / n for c in asked]
    assert np.mean(probed) < 0.2, np.mean(probed)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in hamming_search.nearest(v, F.col("vec_id") % 20 == 0, sample_rows=1_200).collect():
        got[r.query_id].add(r.vec_id)
    best = {}
    for q in range(0, n, 20):
        order = np.argsort(-(x @ x[q]), kind="stable")
        best[q] = set(order[order != q][:20].tolist())
    assert sum(len(best[q] & got[q]) for q in best) / (20 * len(best)) >= 0.95


def test_multi_index_finds_every_code():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (700, 8), dtype=np.uint8)
    index = hamming_search.MultiIndex(codes, 20)
    for q in rng.integers(0, 256, (20, 8), dtype=np.uint8):
        assert index.within(q).tolist() == np.flatnonzero(hamming_search.distances(q, codes) <= 20).tolist()


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [1.0]), (5, [None, 1.0]), (80, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1))
    got = collections.defaultdict(list)
    for r in hamming_search.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == {0: [80, 1, 2, 3], 80: [0, 1, 2, 3]}
    assert hamming_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hamming_search.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_that_find_too_few_meet_all_rows(spark, monkeypatch):
    """With a radius that holds nothing every query takes the way over all rows, and the result is exact."""
    learn = hamming_search.learn
    monkeypatch.setattr(hamming_search, "learn", lambda *a, **kw: dataclasses.replace(learn(*a, **kw), radius=-1))
    monkeypatch.setattr(hamming_search, "BLOCK", 40)
    x = np.random.default_rng(4).normal(size=(130, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hamming_search.nearest(v, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 130, 20):
        order = np.argsort(-(x @ x[q]), kind="stable")
        assert got[q] == order[order != q][:7].tolist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_repeated_rows_of_a_search(spark, kind):
    """A repeated query is one query; repeated candidates are all candidates."""
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (8, [0.5, 0.5]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (7, [0.0, 0.1])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = [(r.rank, r.vec_id) for r in hamming_search.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 9), (2, 9), (3, 8)]


# ---- 7: language ------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    got = language.predict_languages(docs, model).join(docs, "doc_id").filter(language.fold(F.col("doc_id")) == 2)
    right, total = got.filter("lang_pred = lang").count(), got.count()
    assert right / total > 0.97


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(9, 3)).astype(np.float32) * 3
    sizes = np.array([5, 0, 1, 6])
    flat = rng.integers(0, 9, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    got = language.viterbi(table, flat, starts, sizes, 2.0)

    def worth(words, labels):
        return sum(float(table[w, s]) for w, s in zip(words, labels, strict=True)) - 2.0 * sum(a != b for a, b in zip(labels, labels[1:], strict=False))

    for s, n in zip(starts, sizes, strict=True):
        words = flat[s : s + n]
        best = max((worth(words, x) for x in np.ndindex(*[3] * n)), default=0)
        assert worth(words, list(got[s : s + n])) == pytest.approx(best, abs=1e-4)


def test_cut_sequences_have_best_labels():
    """Cutting at deciding words changes no label."""
    rng = np.random.default_rng(6)
    sizes = np.append(rng.integers(0, 60, 80), [0, 1, 2])
    table = (rng.normal(size=(sizes.sum(), 3)) * rng.choice([1.0, 9.0], (sizes.sum(), 1))).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    want = language.viterbi(table, np.arange(len(table)), starts, sizes, 2.0)
    assert (language.cut_viterbi(table, starts, sizes, 2.0) == want).all()


def brute_prediction(model, text: str | None) -> tuple[str, float]:
    """Word by word with plain sums and lists."""
    words = language.words_of(text)
    value, back, letters = None, [], []
    for w in words:
        allowed = model.scripts.get(language.script_of(w[0]))
        s = [sum(float(model.logs[model.rows.get(g, -1)][i]) for g in language.grams(w)) for i in range(len(model.languages))]
        s = [0.0] * len(s) if allowed is None else [x if ok else -1e4 for x, ok in zip(s, allowed, strict=True)]
        letters.append((len(w), allowed is not None))
        if value is None:
            value = s
        else:
            best = max(range(len(s)), key=lambda i: value[i])
            back.append([i if value[i] >= value[best] - model.switch_penalty else best for i in range(len(s))])
            value = [value[back[-1][i]] - (0 if back[-1][i] == i else model.switch_penalty) + s[i] for i in range(len(s))]
    if not words:
        return "und", 0.0
    state = max(range(len(value)), key=lambda i: value[i])
    counts = [0] * len(value)
    for k in range(len(words) - 1, -1, -1):
        counts[state] += letters[k][0] * letters[k][1]
        state = back[k - 1][state] if k else state
    best = max(range(len(counts)), key=lambda i: counts[i]) if any(counts) else model.common
    return model.languages[best], counts[best] / sum(n for n, _ in letters)


def test_predictions_equal_brute_force(spark, docs):
    """The query's predictions over a whole small table."""
    model = language.fit(docs)
    got = {r.doc_id: r for r in queries.op7_viterbi_language(spark, SF).collect()}
    for r in docs.collect():
        lang, score = brute_prediction(model, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_language_edges(spark, edge, docs):
    model = language.fit(docs)
    got = {(r.doc_id): r for r in language.predict_languages(edge, model).collect()}
    assert got[0].lang_pred == "und" and got[2].lang_pred == "und" and got[0].score == 0
    assert model.spans("Москва") == [("und", 0, 1)]
    (far, low), (none, _), (digits, _) = model.predict(["Москва 漢字", None, "12 34"])
    assert far in model.languages and low == 0 and none == digits == "und"
    (long, most), = model.predict(["Donaudampfschifffahrtsgesellschaft" * 150])
    assert long == "de" and most > 0.5
    none = language.fit(edge.filter("lang is null"))
    assert {r.lang_pred for r in language.predict_languages(edge, none).collect()} == {"und"}
    mixed = "the quick of the and that was for with they this der die und nicht ein ist das mit von auch"
    assert len(model.spans(mixed)) >= 1


def test_long_runs_are_read_whole(spark):
    """Of text without spaces every letter counts for its own language and script."""
    rows = [(i, t, x) for i in range(8) for t, x in (("the weather with this thought that" * 3, "en"), ("погода сегодня хорошая очень " * 3, "ru"), ("der zug fährt über die brücke nach köln " * 3, "de"))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out_fold=None)
    head, tail, german = "thethoughtthat" * 6, "погодасегодняхорошая" * 20, "derzugfährtüberdiebrückenachköln" * 20
    assert "".join(language.words_of(head + tail)) == head + tail
    texts = [head + tail, head + german, "the" + "погода" * 3]
    got = list(model.predict(texts))
    assert [x for x, _ in got] == ["ru", "de", "ru"]
    assert got[0][1] == pytest.approx(len(tail) / len(head + tail)) and 0.7 < got[1][1] < 1
    assert [x for x, _, _ in model.spans(head + tail)] == ["en", "ru"]


# ---- 8: sharding ------------------------------------------------------------------


def brute_capacity(sizes: list[int], shards: int) -> int:
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("hot", [0, 50_000])
def test_minimax(spark, hot):
    rng = np.random.default_rng(8)
    groups = [(int(h), int(s)) for h, s in zip(rng.integers(-(1 << 63), (1 << 63) - 1, 300), rng.integers(1, 900, 300), strict=True)]
    groups[7] = (groups[7][0], groups[7][1] + hot)
    capacity, firsts = sharding.minimax_cuts(spark.createDataFrame(groups, "th long, total long"), 16)
    assert capacity == brute_capacity([s for _, s in sorted(groups)], 16)
    load = collections.Counter()
    for h, s in groups:
        load[sum(h >= f for f in firsts)] += s
    assert max(load.values()) == capacity
    rest = sorted(load.values())[: 15 if hot else 16]  # beside the hot group the others share evenly
    assert len(load) == 16 and min(rest) >= sum(rest) / len(rest) - 900, sorted(load.values())


@pytest.mark.parametrize("seed", range(40))
def test_even_cuts_keep_the_capacity(seed):
    """Ranges of one group each: no shard above the smallest capacity, none empty while groups last."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    sizes = [int(s) for s in rng.pareto(1.0, n) * 10 + 1]
    capacity = brute_capacity(sizes, 16)
    cuts, unsure = sharding._Ranges([(i, s, 1) for i, s in enumerate(sizes)], 64).even(capacity, 16)
    loads = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert not unsure and max(loads) == capacity and sum(loads) == sum(sizes)
    assert all(c in {0, *np.cumsum(sizes).tolist()} for c in cuts) and sum(x > 0 for x in loads) == min(n, 16)


def test_loads_of_a_table_are_minimax_and_even(docs):
    rows = sharding.shard_documents(docs).collect()
    load, group = collections.Counter(), collections.Counter()
    order = {r.doc_id: r.th for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    for r in rows:
        load[r.shard] += r.size
        group[order[r.doc_id]] += r.size
    assert max(load.values()) == brute_capacity([group[h] for h in sorted(group)], 16)
    assert len(load) == 16 and min(load.values()) >= sum(load.values()) / 16 - max(group.values())


def test_shards(docs, edge):
    for df in (docs, edge):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count() and all(0 <= r.shard < 16 for r in rows)
        for shard in {r.shard for r in rows}:
            slots = sorted(r.slot for r in rows if r.shard == shard)
            assert slots == list(range(len(slots)))
        homes = collections.defaultdict(set)
        for r in rows:
            homes[r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in homes.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# ---- 9: archives ------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://www.b.org/x#f", "<p>same"), (2, "https://a.org/\r\n", "<p>same"), (3, None, None), (4, "http://c.org", ""), (None, "http://d.org", "own\r\n\r\nWARC/1.1"), (5, "u", "é" * 9000), (1, "http://www.b.org/x#f", "<p>same")]
    rows += [(10 + i, f"http://e.org/{i}", x) for i, x in enumerate(["a\r\n", "\r\n\r\n", "b\r", "\r\n" * 7 + "c", "d\r\n\r\n\r", "long " * 300_000, "\n"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.archive_and_index(pages, str(tmp_path / "warc")).collect()
    assert len(index) == len(rows)
    by = {r.page_id: r for r in index}
    assert (by[2].record_type, by[2].refers_to) == ("revisit", 1) and by[1].record_type == "response" and by[4].refers_to == 3
    for page_id, _, html in rows:
        payload = (html or "").encode()
        import base64

        assert by[page_id].payload_bytes == len(payload) and by[page_id].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    order = [(r.urlkey, r.ts, r.page_id is None, r.page_id or 0) for r in index]
    assert order == sorted(order)
    for r in index:  # every record lies where the index says
        import gzip

        (archive,) = (tmp_path / "warc").glob(r.file)
        record = gzip.decompress(archive.read_bytes())[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{'null' if r.page_id is None else r.page_id}>".encode() in record
    assert warc.archive_and_index(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in range(6):
        runs = [sorted(rng.integers(0, 50, n).tolist()) for n in rng.integers(0, 9, k)]
        assert list(warc.merge_runs(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# ---- 10: pieces -------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [64, 16_384])
def test_pieces_equal_the_library(spark, docs, edge, chunk, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(sentencepiece, "BLOCK", 5)

    library = SentencePieceProcessor(model_file=sentencepiece.public_tokenizers.path("piece_bpe_32k.model"))
    odd = spark.createDataFrame([("a" * 500,), (" " * 300,), ("x\n\ty  z" * 40,), ("=-" * 200,)], "text string")
    for df in (docs.select("text").limit(60), edge.select("text"), odd):
        for r in sentencepiece.decode(sentencepiece.encode(df, chunk=chunk, decoded_col="again")).collect():
            assert r.ids == library.encode(r.text or "") and r.again == r.decoded
            assert r.decoded == (r.text or "").replace("▁", " ")
    assert sentencepiece.encode(edge.limit(0)).count() == 0


def test_units_merged_in_arrays():
    """Side by side or alone, with and without unknown characters, a unit has the same pieces."""
    lat = sentencepiece.lattice(sentencepiece.public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé漢😀,.▁"), rng.integers(1, 30))) for _ in range(500)] + ["a" * 90, ""]
    ids, ends = lat.encode_many(words)
    for w, got in zip(words, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == (lat.to_ids(lat.merge(lat.normal(w))) if w else [])


def test_states_at_cuts():
    steps = [{(0, None): [(0, "x"), (1, "y")]}, {(0, "x"): [(0, "p")], (1, "y"): [(2, "q")]}, {(2, "q"): [(0, None)]}]
    assert sentencepiece.states_at_cuts(steps, (0, None), (0, None)) == [(0, None), (1, "y"), (2, "q"), (0, None)]


def test_transfer_matrices_are_associative():
    a = {(0, None): [(0, "x"), (1, "y")]}
    b = {(0, "x"): [(0, "p")], (1, "y"): [(2, "q")]}
    c = {(0, "p"): [(0, "z")], (2, "q"): [(0, "z"), (1, "w")]}
    assert sentencepiece.compose(sentencepiece.compose(a, b), c) == sentencepiece.compose(a, sentencepiece.compose(b, c))


# ---- all --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == []


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, SF)
    rows = out.select("doc_id", "n_pieces", "round_trip").collect()
    assert rows and all(r.round_trip and r.n_pieces > 0 for r in rows)


# ---- extremes ---------------------------------------------------------------------


def test_huge_and_tiny_vectors_take_part(spark):
    """Squares of components overflow or vanish; the products asked for do not."""
    rng = np.random.default_rng(3)
    by = {i: rng.normal(size=8) * (1.0 if i == 0 else 1e-200 if i % 20 == 0 else 1e200 if i % 2 else 1.0) for i in range(90)}
    v = spark.createDataFrame([(i, x.tolist()) for i, x in by.items()], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hamming_search.nearest(v, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 90, 20):
        assert got[q] == sorted(((i, float((x * by[q]).sum())) for i, x in by.items() if i != q), key=lambda p: (-p[1], p[0]))[:5]


def test_viterbi_of_more_labels_than_a_byte_holds():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(40, 300)).astype(np.float32)
    table[np.arange(40), 260 + np.arange(40) // 10] += 50
    labels = language.viterbi(table, np.arange(40), np.array([0]), np.array([40]), 3.0)
    assert list(labels) == [260 + i // 10 for i in range(40)]


def test_blocks_of_long_texts_in_one_bucket(spark, monkeypatch):
    """Sets of one bucket are cut by their own bytes, whatever the mean of the table is."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2_000)
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(200)]
    texts = [" ".join(common[:40] + [f"w{i}_{k}" for k in range(150)]) for i in range(12)] + [" ".join(common)] * 2
    texts += [" ".join([*common[:100], f"x{rng.integers(9)}", *common[100:]]) for _ in range(6)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()}
    assert len({got[i] for i in range(12, 20)}) == 1 and len({got[i] for i in range(12)}) == 12
