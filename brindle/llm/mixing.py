"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is a number of equal blocks of words. Sources win blocks by highest quotients
(target / 1, 3, 5, ...); the sequence of awards is cut evenly into shards, so every shard
has integer quotas and every prefix of shards is itself a Sainte-Laguë apportionment.
Within a source, documents lie in seeded order on a line of words that is cut into the
same blocks; a seeded permutation of the blocks says which are taken, and how often.

Only per-source rows (one per source and shard) meet in a small window. Documents are
dealt by (source, slice of the seeded order), so a source with a third of all rows is spread
over ``SLICES`` tasks.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own, last in order; equal rows are ordered by id and size and so are interchangeable; an
empty table gives no rows; texts of any length are counted and cut whole; ``mix`` returns its own columns only,
``mixed_documents`` all of the table's, which cannot clash because work columns start with ``_mix``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 1024
#: The permutation j -> (a * j + b) mod n needs an a coprime to n: the first of these that does not divide n.
#: They are below 2**20, so a * j stays exact up to 2**43 blocks. Documents are in seeded order already.
PRIMES = (1048573, 1048571, 1048559, 1048549)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(k, source, source_size) -> the same with rank, weight, target.

    Sources share the sum of sizes by weight. A target stops at ``max_repeat`` times its
    source's size; the excess is shared again by weight until none is above. In closed form:
    with sources in order of cap / weight, the first that stays below its cap sets the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    r = sizes.withColumn("rank", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    r = r.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    line = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(1))
    r = r.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "caps_before": F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weight_from")
    r = r.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    r = r.withColumn("level", F.max("level").over(everything))
    return r.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")))


def shard_quotas(targets: DataFrame, block_words: int = 64, n_shards: int = 16, blocks_per_source: int = 256) -> DataFrame:
    """Per source: block (words), n_blocks of its line, and ``cum``: blocks won up to each shard.

    Blocks hold ``block_words`` words, fewer where the tables are so small that an average
    source would not win ``blocks_per_source`` of them. For M awards among S sources with
    votes v (sum V), dividing by V / (M - S/2) and rounding awards at most M, all of them
    among the M highest quotients; what is left is at most about 2 S quotients, which are ranked.
    """
    everything = Window.partitionBy(F.lit(1))
    t = targets.withColumns({"S": F.count(F.lit(1)).over(everything).cast("double"), "V": F.sum("target").over(everything)})
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("V") / (F.col("S") * blocks_per_source)))).cast("long")
    t = t.withColumn("block", block).withColumn("M", F.round(F.col("V") / F.col("block")))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    t = t.withColumn("seats", F.floor(F.col("M") * F.col("shard") / n_shards))
    divisor = F.when(F.col("seats") > F.col("S") / 2, F.col("V") / (F.col("seats") - F.col("S") / 2))
    base = F.greatest(F.lit(0), F.coalesce(F.floor(F.col("target") / divisor + 0.5) - 1, F.lit(0)))
    more = F.ceil(F.coalesce(F.col("target") * F.col("S") / F.nullif(F.col("V"), F.lit(0.0)), F.lit(0.0))) + 4
    t = t.withColumn("base", base.cast("long")).withColumn("more", more.cast("long"))
    t = t.withColumn("left", F.col("seats") - F.sum("base").over(Window.partitionBy("shard")))
    q = t.withColumn("nth", F.explode(F.sequence(F.col("base") + 1, F.col("base") + F.col("more"))))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("nth") - 1)).desc(), "rank", "nth")
    q = q.withColumn("won", ((F.row_number().over(best) <= F.col("left")) & (F.col("target") > 0)).cast("long"))
    per = q.groupBy("k", "shard").agg((F.first("base") + F.sum("won")).alias("quota"), *[F.first(c).alias(c) for c in ("source_size", "target", "block", "rank")])
    n_blocks = F.greatest(F.ceil(F.first("source_size") / F.first("block")), F.lit(1)).cast("long")
    cum = F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"])
    return per.groupBy("k").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "block", "rank")], n_blocks.alias("n_blocks"), cum.alias("cum"))


def mix(docs: DataFrame, seed: int = 7, block_words: int = 64, n_shards: int = 16, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, block, taken, slices) of every document.

    ``slices`` are the words the mix takes: structs of first word, end word, pass (from 0,
    below ``max_repeat``) and shard; ``taken`` is the sum of their lengths. With ``carry`` the
    columns of ``docs`` come instead, and ``_mix_slices`` after them.
    """
    k = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    work = {"_mix_id": F.col(id_col), "_mix_source": F.col(source_col), "_mix_size": n_words(F.col(text_col)), "_mix_k": k, "_mix_o": order}
    work["_mix_slice"] = F.pmod(F.shiftrightunsigned(order, 40), F.lit(SLICES)).cast("int")
    rows = cut(docs.select(*[c.alias(n) for n, c in work.items()]))

    per_slice = rows.groupBy("_mix_k", "_mix_slice").agg(F.sum("_mix_size").alias("words"), F.first("_mix_source").alias("source"))
    sizes = per_slice.groupBy("_mix_k").agg(F.sum("words").alias("source_size"), F.first("source").alias("source")).withColumnRenamed("_mix_k", "k")
    quotas = cut(shard_quotas(source_targets(sizes, max_repeat, weights), block_words, n_shards))

    along = Window.partitionBy("_mix_k").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.withColumn("_mix_start", F.coalesce(F.sum("words").over(along), F.lit(0))).drop("words", "source")
    starts = starts.join(quotas.select(*[F.col(c).alias(f"_mix_{c}") for c in quotas.columns if c != "rank"]), "_mix_k")

    within = Window.partitionBy("_mix_k", "_mix_slice").orderBy("_mix_o", "_mix_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (docs.withColumns(work) if carry else rows).withColumn("_mix_off", F.coalesce(F.sum("_mix_size").over(within), F.lit(0))).join(starts, ["_mix_k", "_mix_slice"])
    at = F.col("_mix_start") + F.col("_mix_off")
    size, block, n = F.col("_mix_size"), F.col("_mix_block"), F.col("_mix_n_blocks")
    quota = F.least(F.element_at("_mix_cum", -1), n * max_repeat)
    a = F.coalesce(*[F.when(n % p != 0, F.lit(p).cast("long")) for p in PRIMES[:-1]], F.lit(PRIMES[-1]).cast("long"))
    b = F.pmod(F.xxhash64(F.lit(seed), "_mix_k"), n)

    def pieces(j: Column) -> Column:
        rank = (F.pmod(a, n) * j + b) % n
        passes = F.when(quota > rank, F.floor((quota - 1 - rank) / n) + 1).otherwise(0).cast("int")
        first, end = F.greatest(j * block - at, F.lit(0)), F.least((j + 1) * block - at, size)
        one = lambda p: F.struct(
            first.cast("long").alias("first"), end.cast("long").alias("end"), p.cast("int").alias("pass"),
            F.size(F.filter("_mix_cum", lambda c: c <= rank + p * n)).cast("int").alias("shard"),
        )
        return F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), one)).otherwise(F.array().cast("array<struct<first:bigint,end:bigint,pass:int,shard:int>>"))

    blocks = F.when(size > 0, F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))).otherwise(F.array().cast("array<bigint>"))
    slices = F.flatten(F.transform(blocks, pieces))
    if carry:
        return placed.select(*[docs[c] for c in docs.columns], slices.alias("_mix_slices"))
    placed = placed.withColumn("slices", slices)
    taken = F.aggregate("slices", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return placed.select(
        F.col("_mix_id").alias(id_col), F.col("_mix_source").alias(source_col), size.alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), block.alias("block"), taken.alias("taken"), "slices",
    )


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def mixed_texts(text: str, slices: list[dict]) -> list[str]:
    """The text of each pass: whole where all its words are taken, else the taken words in order."""
    passes: dict[int, list[dict]] = {}
    for s in slices:
        passes.setdefault(s["pass"], []).append(s)
    tokens: list[str] | None = None
    out = []
    for _, parts in sorted(passes.items()):
        parts.sort(key=lambda s: s["first"])
        tokens = tokens or _TOKEN.findall(text)
        if sum(s["end"] - s["first"] for s in parts) == len(tokens):
            out.append(text)
        else:
            out.append("".join(t for s in parts for t in tokens[s["first"] : s["end"]]).rstrip(" \t\n\r\x0b\x0c"))
    return out


def mixed_documents(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix itself: a row per document and pass with the words taken; columns as in ``docs``."""
    placed = mix(docs, text_col=text_col, carry=True, **options)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (text, slices) in enumerate(zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if slices:
                    found = mixed_texts(text, slices)
                    rows += [i] * len(found)
                    texts += found
            out = batch.select(names).take(pa.array(rows, pa.int64()))
            yield out.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = placed.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars_col, F.length(text_col).cast("long")) if n_chars_col in names else out
