"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are reduced to directions in a way that keeps the order of inner products (one
more coordinate makes up for shorter vectors), then several learned rotations (iterative
quantisation on a bounded sample) give signs. Every row is indexed: its code is cut into
8-bit substrings, and each block of candidates has one table per substring.

Search: codes within Hamming radius r of a query agree with it in some substring up to
r // (number of substrings) bits, so probing those buckets of each substring finds every one.
Each table holds, per value, the union of the buckets to probe as a bit set; a query's
candidates are the union of one bit set per substring. Those within r are reranked by inner
product of the original vectors in double precision.

Queries, a stated part of the rows, meet all candidates in blocks of bounded size; each block pair returns a
query's best k, and a last ranking takes k of those. Blocks of queries are large, so that candidates are copied to few. Queries that find fewer than k within r are
compared with all rows in the same blocks, so rows are only missing where candidates are.

Defined results: null, zero, ragged (other than the most frequent length) and non-finite
vectors take no part; equal scores go to the smaller id; equal vectors and rows that repeat another id are all
returned; rows that repeat a query's id are one query (of several vectors the one of least code and bytes asks), which
never returns its own id; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from brindle.session import cut

#: Rows of a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4096, 16_384
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class Codes:
    """What was learned of vectors scaled by their largest component: centre and rotation, the largest norm, the radius."""

    centre: np.ndarray
    rotation: np.ndarray
    norm: float
    radius: int

    def encode(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """(n, bytes) of codes; one byte is one substring."""
        return np.packbits((lift(x, self.norm, queries) - self.centre) @ self.rotation > 0, axis=1)


def lift(x: np.ndarray, norm: float, queries: bool) -> np.ndarray:
    """Unit vectors whose inner products order candidates as those of the original vectors do.

    A query's length does not matter, so it is scaled by its largest component, lest squares overflow or vanish.
    """
    if queries:
        x = x / np.maximum(np.abs(x).max(1), np.finfo(np.float64).tiny)[:, None]
        return np.column_stack([x / np.maximum(1.0, np.sqrt((x * x).sum(1)))[:, None], np.zeros(len(x))])
    length = np.sqrt((x * x).sum(1))
    return np.column_stack([x / norm, np.sqrt(np.maximum(0.0, 1.0 - (length / norm) ** 2))])


def distances(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(-1, dtype=np.int64)


def learn(sample: np.ndarray, norm: float, bits: int = 256, k: int = 20, quantile: float = 0.97, steps: int = 25, seed: int = 11, share: float = 1.0) -> Codes:
    """Rotations by iterative quantisation; the radius holds ``quantile`` of the sample's own nearest.

    A sample that is a ``share`` of all rows has that share of each row's k nearest, so so many of its nearest are
    asked for: the radius fits the density of the whole table and not that of the sample.
    """
    k = max(1, math.ceil(k * share))
    rng = np.random.default_rng(seed)
    lifted = lift(sample, norm, False)
    centre = lifted.mean(0)
    z = lifted - centre
    dim = min(sample.shape[1], bits)
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :dim]
    z = z @ axes
    parts = []
    for _ in range(math.ceil(bits / dim)):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        parts.append(axes @ r)
    codes = Codes(centre, np.concatenate(parts, 1), norm, 0)
    index = codes.encode(sample, False)
    asked = rng.permutation(len(sample))[:256]
    far = []
    for i, code in zip(asked, codes.encode(sample[asked], True), strict=True):
        score = sample @ sample[i]
        score[i] = -np.inf
        best = np.argsort(-score)[: min(k, len(sample) - 1)]
        far.append(distances(code, index[best]))
    radius = int(np.quantile(np.concatenate(far), quantile)) if far and far[0].size else index.shape[1] * 8
    return Codes(codes.centre, codes.rotation, norm, radius)


class MultiIndex:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray, radius: int) -> None:
        self.codes, self.radius = codes, radius
        n, m = codes.shape
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= radius // m
        probes = [np.flatnonzero(row) for row in near]
        self.tables = np.zeros((m, 256, (n + 7) // 8), np.uint8)
        values = np.arange(256, dtype=np.uint8)[:, None]
        for s in range(m):
            buckets = np.packbits(codes[:, s] == values, axis=1)
            for v in range(256):
                np.bitwise_or.reduce(buckets[probes[v]], axis=0, out=self.tables[s, v])

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows of all codes within the radius."""
        probed = np.bitwise_or.reduce(self.tables[np.arange(len(code)), code], axis=0)
        rows = np.flatnonzero(np.unpackbits(probed, count=len(self.codes)))
        return rows[distances(code, self.codes[rows]) <= self.radius]


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _best(query_id: int, vector: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[ids[rows] != query_id]
    score = (vectors[rows] * vector).sum(1)
    order = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][order], score[order]


def _search(queries: DataFrame, index: DataFrame, k: int, radius: int | None, n_query_blocks: int, n_blocks: int, kind: type) -> DataFrame:
    """Each block pair's best k per query: within the radius, or of all rows where it is None.

    Columns of queries get names, and so attributes, of their own: both sides come from one table, and a cogroup of
    sides that share an attribute loses it.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "v", "code")])
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("qb", F.pmod(F.xxhash64("q_id", F.lit(1)), F.lit(n_query_blocks)).cast("int"))
    c = index.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, vectors = right["id"].to_numpy(), _matrix(right["v"], kind)
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            tables = None if radius is None else MultiIndex(codes, radius)
            everything = np.arange(len(ids))
            for qid, vector, code in zip(left["q_id"], _matrix(left["q_v"], kind), left["q_code"], strict=True):
                rows = everything if tables is None else tables.within(np.frombuffer(code, np.uint8))
                found, score = _best(qid, vector, ids, vectors, rows, k)
                out.append(pd.DataFrame({"query_id": np.full(len(found), qid, np.int64), "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(block, FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 20, bits: int = 256, sample_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row for which ``is_query`` holds.

    ``sample_rows`` bounds (in expectation) the rows whose vectors are gathered for learning.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = np.float32 if isinstance(element, FloatType) else np.float64  # vectors are kept as they came, scores are double
    v = F.col(vector_col) if kind is np.float32 else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Candidates are scaled by the largest component of all, so that no square overflows.
    rows = rows.filter(F.size("v") > 0).filter(~bad).withColumn("peak", F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).filter("peak > 0")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("peak"), F.count_if("asks").alias("asked")).orderBy(F.col("n").desc(), "dim").first()
    if lengths is None or not lengths["asked"]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == lengths["dim"])
    peak = lengths["peak"]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / F.lit(peak), F.lit(2.0)))
    norm = math.sqrt(rows.agg(F.max(square)).head()[0])
    share = min(1.0, sample_rows / lengths["n"])
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 11) <= F.lit(int(share * (1 << 53)))).orderBy("id").select("v").collect()
    codes = learn(np.array([r[0] for r in sample], np.float64).reshape(len(sample), lengths["dim"]) / peak, norm, bits, k, share=min(1.0, len(sample) / lengths["n"])) if len(sample) > 1 else None

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            x = own.astype(np.float64)
            asks = np.array(batch.column(2).to_pylist(), bool)
            out = [(c.tobytes(), q.tobytes() if a else None) for c, q, a in zip(codes.encode(x / peak, False), codes.encode(x, True), asks, strict=True)] if codes and len(x) else [(b"\0", b"\0" if a else None) for a in asks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([c for c, _ in out], pa.binary()), pa.array([q for _, q in out], pa.binary())], ["id", "v", "code", "asked"]
            )

    indexed = cut(rows.select("id", "v", "asks").mapInArrow(index, "id bigint, v binary, code binary, asked binary"))
    candidates = indexed.select("id", "v", "code")
    queries = indexed.filter("asked is not null").groupBy("id").agg(F.min(F.struct("asked", "v")).alias("q")).select("id", "q.v", F.col("q.asked").alias("code"))
    n_blocks, n_query_blocks = math.ceil(lengths["n"] / BLOCK), math.ceil(lengths["asked"] / QUERY_BLOCK)
    found = cut(_search(queries, candidates, k, codes.radius if codes else None, n_query_blocks, n_blocks, kind))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, lengths["n"] - 1))
    poor = cut(queries.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"))
    n_poor = poor.count()
    if n_poor:
        rest = _search(poor, candidates, k, None, math.ceil(n_poor / QUERY_BLOCK), n_blocks, kind)
        found = found.join(poor.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
