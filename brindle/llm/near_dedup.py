"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

Sets: the five-word windows of a text. Every element owns a strip of the (weight, rank) plane; unit-rate Poisson darts are hashed into it, the same
for every document. A document sees the darts below its weights, up to a rank at which it
expects a few darts per coordinate (raised where a coordinate stays empty); the earliest dart of each
coordinate is its signature. Work is in proportion to elements plus darts, whatever
the weights, and two signatures agree in a coordinate with probability of their (weighted)
Jaccard similarity.

Equal texts collapse first (map-side aggregation). Distinct texts meet where all rows of a
band agree: every member of a bucket is compared with the bucket's best connected member
only, by exact similarity of window sets; links give components. In buckets that still hold
several components, those members outside the largest one are compared with the rest in
blocks: a block pair finds its candidates by the least window hashes of each set (two sets that are
similar enough share one of those), checks them exactly, and gives only links that join what
was not yet joined. So no bucket is capped and no link between texts in a common bucket is
lost; neither copies nor buckets are expanded into pairs. What is lost are links between texts that share
no bucket: at similarity s that is (1 - s ** rows) ** bands, 7e-5 at 0.8.

With ``counted`` a window weighs as often as it is found, in signatures and in the exact checks
(weighted Jaccard similarity); else it weighs 1.

Defined results: null texts are alone in their class; texts without words are copies only of
equal texts; a text of under five words is one window; a class is named by its smallest
doc_id (null last); repeated rows are in one class, of which ``keep_one`` leaves one row;
empty tables give no rows; texts are read whole, in memory in proportion to one text; work columns are named ``_nd_*``, so others cannot clash.
Nodes are 64-bit hashes of MD5 sums of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text_hashes import U, groups, mix, windows, word_hashes
from brindle.session import cut
from brindle.llm.workers import giving_back

#: Members of a block, and bytes of window sets in it (in expectation) where sets are large.
BLOCK, BLOCK_BYTES = 512, 4 << 20


@dataclass(frozen=True)
class Banding:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    counted: bool = False

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from the upper bits."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, k: int, darts_per_coordinate: float = 5.0) -> np.ndarray:
    """(n_docs, k) signatures of sets given as (document, element, weight) rows; 0 where a set is empty."""
    best = np.full(n_docs * k, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(docs, weights, n_docs)
    # A cell is one unit of an element's weight; the last may be cut by the weight.
    cells = np.ceil(weights).astype(np.int64)
    if len(docs) and cells.max() > 1:
        at = np.repeat(np.arange(len(docs)), cells)
        level = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        seeds = mix(elements[at] + level.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        room = np.minimum(weights[at] - level, 1.0)
        docs = docs[at]
    else:
        seeds, room = mix(elements), weights
    rank = -np.log(_unit(mix(seeds)))
    nth = np.zeros(len(seeds), np.uint64)
    limit = darts_per_coordinate * k / np.maximum(total, 1e-300)
    active = np.arange(len(seeds))
    while len(active):
        near = active
        while len(near := near[rank[near] < limit[docs[near]]]):
            dart = mix(seeds[near] ^ mix(nth[near] + U(1)))
            inside = _unit(mix(dart + U(1))) <= room[near]
            value = (rank[near].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (dart & U(0xFFFFFFFF))
            slot = docs[near] * k + (mix(dart + U(2)) % U(k)).astype(np.int64)
            np.minimum.at(best, slot[inside], value[inside])
            nth[near] += U(1)
            rank[near] -= np.log(_unit(mix(seeds[near] + nth[near] * U(0xD1B54A32D192ED03))))
        missing = (best.reshape(n_docs, k) == np.iinfo(np.uint64).max).any(1) & (total > 0)
        limit = np.where(missing, limit * 2, limit)
        active = np.flatnonzero(missing[docs]) if missing.any() else active[:0]
    ids = (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, k)
    ids[total == 0] = 0
    return ids


def window_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, window hash, times) sorted by document, then hash."""
    docs, hashes = windows(*word_hashes(data, starts, ends), words)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    first = np.ones(len(docs), bool)
    first[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return docs[at], hashes[at], np.diff(np.append(at, len(docs)))


def _sign(b: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts, ends in groups(batch.column("_nd_text")):
                docs, elements, times = window_sets(data, starts, ends, b.words)
                ids = dart_signatures(docs, elements, times.astype(np.float64) if b.counted else np.ones(len(docs)), j - i, b.coordinates)
                band = np.zeros((j - i, b.bands), np.uint64)
                for r in range(b.rows):
                    band = mix(band + ids.reshape(j - i, b.bands, b.rows)[:, :, r])
                band = mix(band + np.arange(1, b.bands + 1, dtype=np.uint64))
                some = np.zeros(j - i, bool)
                some[docs] = True
                sizes = np.where(some, b.bands, 0)
                flat = pa.array(band[some].reshape(-1).view(np.int64), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)
                rows = batch.slice(i, j - i)
                size = pa.array(np.bincount(docs, minlength=j - i) if not b.counted else np.bincount(docs, times, j - i).astype(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("_nd_id"), rows.column("_nd_key"), lists, size], ["_nd_id", "_nd_key", "bands", "size"])

    return run


def _node(key):
    return F.xxhash64(key)


def expanded(docs: np.ndarray, elements: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counted sets as plain ones, sorted: an element found n times is n elements."""
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    docs, elements = np.repeat(docs, times), mix(np.repeat(elements, times) + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.lexsort((elements, docs))
    return docs[order], elements[order]


def _alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Is the Jaccard similarity of two sorted arrays of distinct hashes large enough?"""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small) or len(small) < similarity * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= similarity * (len(p) + len(q) - both) - 1e-9


def _window_sets(wanted: DataFrame, texts: DataFrame, reps: DataFrame, b: Banding) -> DataFrame:
    """(node, windows): the sorted window hashes of wanted nodes as bytes.

    Texts meet the wanted nodes by node and id of the node's representative, so that the copies
    of one text are dealt to many tasks.
    """
    w = wanted.join(reps, "node").select(F.col("node").alias("_nd_w"), "_nd_rep")
    one = texts.join(w, (F.col("node") == F.col("_nd_w")) & F.col("_nd_id").eqNullSafe(F.col("_nd_rep")), "left_semi")
    found = one.groupBy("node").agg(F.first("_nd_text").alias("_nd_text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts, ends in groups(batch.column(1)):
                docs, elements, times = window_sets(data, starts, ends, b.words)
                if b.counted:
                    docs, elements = expanded(docs, elements, times)
                edge = np.searchsorted(docs, np.arange(j - i + 1))
                raw = elements.tobytes()
                out = pa.array([raw[8 * x : 8 * y] for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), out], ["node", "windows"])

    return cut(found.mapInArrow(giving_back(sets), "node bigint, windows binary"))


def _checked(pairs: DataFrame, sets: DataFrame, b: Banding) -> DataFrame:
    """Those (a, b) of ``pairs`` whose window sets (node, windows) are similar enough, exactly."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), b.similarity) for x, y in zip(batch.column("wa"), batch.column("wb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("windows").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("windows").alias("wb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(giving_back(similar), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component of (a, b) links.

    Every round takes the least label among neighbours and then jumps to the label's label,
    so the number of rounds grows with the logarithm of a path's length.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = cut(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = step.select("node", "comp")
        if step.filter("old != comp").isEmpty():
            return labels


def prefix(windows: np.ndarray, similarity: float) -> np.ndarray:
    """The least hashes of a sorted set, one of which any set that is similar enough has among its own."""
    return windows[: len(windows) - math.ceil(similarity * len(windows) - 1e-9) + 1]


def candidates(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): which sets of ``right`` share a prefix hash with set i of ``left``; every similar one is among them."""
    parts = [prefix(w, similarity) for w in right]
    keys, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    for i, w in enumerate(left):
        mine = prefix(w, similarity)
        lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        n = hi - lo
        yield i, np.unique(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])


def _mixed_links(members: DataFrame, sets: DataFrame, b: Banding) -> DataFrame:
    """Links that join components in buckets which hold several.

    ``members``: (h, node, comp, main, nb, ob): whether the node is in the bucket's largest component, and the
    bucket's number of blocks of such nodes and of others. Others meet each other and the main ones in pairs of
    blocks, one group each; a main node is sent to every block of others, of which there are few where one
    component prevails. The buckets' keys are dealt before window sets are joined, by node.
    """
    own = F.pmod(F.xxhash64("node", "h"), F.when(F.col("main"), F.col("nb")).otherwise(F.col("ob"))).cast("int")
    m = members.withColumn("own", own)
    last = F.col("ob") - 1
    meets = F.when(F.col("main"), F.transform(F.sequence(F.lit(0), last), lambda y: F.struct((-1 - F.col("own")).alias("x"), y.cast("int").alias("y"))))
    pairs = F.transform(F.sequence(F.lit(0), last), lambda y: F.struct(F.least(y.cast("int"), "own").alias("x"), F.greatest(y.cast("int"), "own").alias("y")))
    mains = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct((-1 - x.cast("int")).alias("x"), F.col("own").alias("y")))
    m = m.withColumn("at", F.explode(F.coalesce(meets, F.concat(mains, pairs)))).select("h", "node", "comp", "own", "main", "at.x", "at.y")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        node, main, own = group["node"].to_numpy(), group["main"].to_numpy(), group["own"].to_numpy()
        comp = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        windows = [np.frombuffer(w, np.uint64) for w in group["windows"]]
        x = group["x"].iloc[0]
        left = np.flatnonzero(~main & (own == group["y"].iloc[0]))
        right = np.flatnonzero(main) if x < 0 else np.flatnonzero(~main & (own == x))
        out = []
        if len(left) and len(right):
            for k, near in candidates([windows[i] for i in left], [windows[j] for j in right], b.similarity):
                i = left[k]
                for j in right[near]:
                    if comp[j] != comp[i] and _alike(windows[i], windows[j], b.similarity):
                        out.append((min(node[i], node[j]), max(node[i], node[j])))
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return m.join(sets, "node").groupBy("h", "x", "y").applyInPandas(links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, key) of every document; key is the text's MD5, null for null texts."""
    b = banding
    work = docs.select(F.col(id_col).alias("_nd_id"), F.md5(text_col).alias("_nd_key"), F.col(text_col).alias("_nd_text"))
    id_type = work.dtypes[0][1]
    schema = f"_nd_id {id_type}, _nd_key string, bands array<bigint>, size bigint"
    signed = cut(work.mapInArrow(giving_back(_sign(b)), schema))
    distinct = signed.filter("_nd_key is not null").groupBy("_nd_key").agg(F.min("_nd_id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    nodes = cut(distinct.withColumn("node", _node("_nd_key")))
    texts = work.filter("_nd_key is not null").select(_node("_nd_key").alias("node"), "_nd_id", "_nd_text")
    reps = nodes.select("node", F.col("rep").alias("_nd_rep"))

    rows = nodes.select("node", "size", F.explode("bands").alias("h"))
    # Sums by bucket are cut, so that joins with them are of two plain shuffles and a hot bucket can be split.
    shared = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = cut(rows.join(shared, "h").select("h", "node", "n", "size"))
    # The centre of a bucket is its best connected member: in a group of near copies that is the text they come from.
    fame = met.groupBy("node").agg(F.sum("n").alias("fame"))
    centres = cut(met.join(fame, "node").groupBy("h").agg(F.min(F.struct(-F.col("fame"), F.col("node")))["node"].alias("a")))
    pairs = met.join(centres, "h").filter("a != node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    pairs = cut(pairs.distinct())
    # Every node that shares a bucket is in a pair, so its window set is made here, once.
    sets = _window_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, reps, b)
    links = cut(_checked(pairs, sets, b))
    labels = components(links)

    large = cut(met.filter("n > 2").join(labels, "node", "left").select("h", "node", F.coalesce("comp", "node").alias("comp"), "size"))
    # First by bucket and component, so that a hot bucket is a few rows before it is summed up.
    per = large.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes"), F.bit_xor("node").alias("who"))
    mixed = per.groupBy("h").agg(F.max(F.struct("n", "comp", "bytes")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("who").alias("who")).filter("comps > 1")
    # Bands in which the same texts meet make equal buckets; one of them is enough.
    mixed = mixed.groupBy("top", "comps", "n", "bytes", "who").agg(F.min("h").alias("h"))
    # Blocks by members and by the bytes of their own window sets, so that a bucket of long texts has small ones.
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.least(n, F.ceil(size / BLOCK_BYTES))).cast("int")
    of_main, of_others = blocks(F.col("top.n"), F.col("top.bytes")), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    mixed = mixed.select("h", F.col("top.comp").alias("main"), of_main.alias("nb"), of_others.alias("ob"))
    members = large.join(cut(mixed), "h").withColumn("main", F.col("comp") == F.col("main"))
    more = cut(_mixed_links(members, sets, b))
    if not more.isEmpty():
        labels = components(links.union(more))

    named = nodes.select("_nd_key", "node", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = cut(named.groupBy("comp").agg(F.min("rep").alias("class_id")))
    named = named.join(classes, "comp").select("_nd_key", "class_id")
    out = signed.select("_nd_id", "_nd_key").join(named, "_nd_key", "left")
    alone = F.when(F.col("_nd_key").isNull(), F.col("_nd_id")).otherwise(F.col("class_id"))
    return out.select(F.col("_nd_id").alias(id_col), alone.alias("class_id"), F.col("_nd_key").alias("text_key"))


def keep_one(docs: DataFrame, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of its smallest id; all columns of ``docs`` stay. Null texts all stay."""
    found = near_duplicates(docs, banding, id_col, text_col).filter("text_key is not null")
    best = found.groupBy("class_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_key").alias("key"))).alias("w"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    winners = best.select(F.col("w.key").alias("_nd_key"), name("w.id").alias("_nd_name"))
    # Repeated rows are dropped by the keys of the join, so the texts are shuffled once.
    keyed = docs.filter(F.col(text_col).isNotNull()).withColumns({"_nd_key": F.md5(text_col), "_nd_name": name(id_col)})
    kept = keyed.join(winners, ["_nd_key", "_nd_name"], "left_semi").dropDuplicates(["_nd_key", "_nd_name"]).drop("_nd_key", "_nd_name")
    return kept.unionByName(docs.filter(F.col(text_col).isNull()))
