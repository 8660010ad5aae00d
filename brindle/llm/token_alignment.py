"""Alignment of two tokenizers' tokens by the bytes they cover, with corpus-wide counts of linked id pairs.

Per run of texts, in one Arrow pass: B's tokens form a static interval index (their sorted starts and ends); every A token is a stabbing query that
two bisections answer with the list of B tokens it overlaps. Gaps between B tokens that no A
token spans are the borders of groups. Texts in a run lie behind one another in one byte line, which
ends of texts cut by themselves, so all is vectorised.

Link counts of id pairs are packed per run and bucket of pairs (sorted codes, compressed), so a pair costs a few
bytes and not a row. Counts over the corpus are summed from these packs; then packs meet the counts of their bucket: both are dealt by
(bucket, salt) and sorted, counts in front, and every task streams packs past the one bucket it holds. Counts are repeated for
each salt, of which there are as many as the packs' bytes ask for. Texts are read once and never shuffled.

A: a byte-level BPE file of ``tokenizers`` over space+text; B: a ``sentencepiece`` model over the text, to which it adds the
space. Special tokens are not added, and their strings inside texts are plain text.

Defined results: a text that is null or empty, or whose tokens' joined bytes differ from space+text in A or B (as one
with U+2581 in B), has no tokens and only zeros; every row gives one row, repeated rows count as often as they are there; null
ids stay; texts are encoded whole, in memory in proportion to one text; work columns are named ``_ta_*`` and only id and text
are read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text_hashes import U, groups, mix
from brindle.llm.token_count import byte_letters
from brindle.llm.workers import giving_back
from brindle.session import cut

#: Buckets of id pairs; bytes of packs for one task of the second pass.
BUCKETS, PACK_BYTES = 16, 64 << 20
#: Bytes of text that are aligned at once, one text at least.
RUN_BYTES = 512 << 10
#: Below this letter no two versions of Unicode in use differ in what is a letter, a digit or white space.
SETTLED = "\u0530"
#: Pairs that are summed up before they leave a task of the counting pass.
SUMMED = 4 << 20

FOUND = "_ta_row bigint, {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, _ta_bucket int, _ta_first bigint, _ta_codes binary, _ta_docs binary, _ta_times binary"
_codec = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest type that fits: its width, the length, then compressed bytes."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    raw = values.astype(kind).tobytes()
    return bytes([kind.itemsize]) + len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    raw = _codec.decompress(packed[9:], int.from_bytes(packed[1:9], "little"), asbytes=True)
    return np.frombuffer(raw, np.dtype(f"u{packed[0]}"))


@dataclass
class Tokenizers:
    """Both tokenizers and the bytes of their tokens; made where it is used, from two paths."""

    a_path: str
    b_path: str
    a: object = field(init=False)
    b: object = field(init=False)

    def __post_init__(self) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=self.b_path)
        of_letter = {c: i for i, c in enumerate(byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(of_letter[c] for c in entry) if all(c in of_letter for c in entry) else entry.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        # The same vocabulary as ranks of byte strings, where the file's merges are in order of their ids.
        model = json.loads(self.a.to_str())["model"]
        ids = [entries["".join(m)] for m in model["merges"]]
        self.ranked = None
        if ids == sorted(ids):
            import tiktoken

            ranks = {self.a_bytes[i]: i for entry, i in model["vocab"].items() if all(c in of_letter for c in entry)}
            self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids; texts of letters whose classes are settled (Latin, Greek, Cyrillic) go the faster way, which gives the same ids."""
        plain = [self.ranked is not None and (t.isascii() or max(t) < SETTLED) for t in texts]
        rest = iter(self.a.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.ranked.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and B; none for texts of which either does not give all bytes."""
        got_a = self.encode_a([" " + t for t in texts])
        got_b = self.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join([self.a_bytes[i] for i in got_a[k]]) != want or b"".join([self.b_bytes[i] for i in got_b[k]]) != want:
                got_a[k], got_b[k] = [], []
        return got_a, got_b


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end) of the B tokens that each A token overlaps, and whether the gap in front of each B token is a border of groups."""
    b_end = np.cumsum(b_sizes)
    b_start, a_end = b_end - b_sizes, np.cumsum(a_sizes)
    first = np.searchsorted(b_end, a_end - a_sizes, "right")
    end = np.searchsorted(b_start, a_end, "left")
    spans = np.zeros(len(b_sizes) + 2, np.int64)  # A token i spans the gaps in front of first + 1 up to end - 1
    np.add.at(spans, first + 1, 1)
    np.add.at(spans, end, -1)
    return first, end, np.cumsum(spans)[: len(b_sizes)] == 0


class _Writer:
    """Texts of groups: ids with what follows them, as one table of strings per tokenizer and separator."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.base = n_a + n_b
        self.table = [f"{i}{sep}" for sep in (",", "|", ";") for n in (n_a, n_b) for i in range(n)]
        self.n_a = n_a

    def codes(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
        """Places in the table in order of (group, side)."""
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        return np.concatenate([a + last_a * self.base, self.n_a + b + last_b * 2 * self.base])[order]

    def digest(self, codes: np.ndarray) -> str:
        return sha256("".join([self.table[c] for c in codes.tolist()])[:-1].encode()).hexdigest() if len(codes) else ""


def _align(a_path: str, b_path: str, kinds: list[tuple[str, pa.DataType | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(a_path, b_path)
        writer, n_b = _Writer(len(t.a_bytes), len(t.b_bytes)), len(t.b_bytes)
        for batch in batches:
            texts = batch.column("_ta_text")
            schema = pa.schema([(name, kind or batch.column(name).type) for name, kind in kinds])
            for i, j, *_ in groups(texts, RUN_BYTES):
                rows = np.asarray(batch.column("_ta_row").slice(i, j - i))
                got_a, got_b = t.encode(texts.slice(i, j - i).fill_null("").to_pylist())
                of_a, of_b = np.array([len(x) for x in got_a]), np.array([len(x) for x in got_b])
                a, b = (np.concatenate([np.array(x, np.int64) for x in got]) for got in (got_a, got_b))
                first, end, border = overlaps(t.a_sizes[a], t.b_sizes[b])
                group_b = np.cumsum(border)
                group_a = group_b[first]
                edge_a, edge_b = np.append(0, np.cumsum(of_a)), np.append(0, np.cumsum(of_b))
                codes, both = writer.codes(a, b, group_a, group_b), edge_a + edge_b
                n = end - first
                doc_a = np.repeat(np.arange(j - i), of_a)
                borders, links = np.append(0, np.cumsum(border)), np.append(0, np.cumsum(n))
                stats = {
                    "_ta_row": rows, "_ta_id": batch.column("_ta_id").slice(i, j - i), "n_a": of_a, "n_b": of_b, "n_groups": np.diff(borders[edge_b]), "n_links": np.diff(links[edge_a]),
                    "groups_sha256": [writer.digest(codes[x:y]) for x, y in zip(both[:-1], both[1:], strict=True)],
                }
                yield _batch(stats, schema, j - i)
                at = np.repeat(np.arange(len(a)), n)
                other = first[at] + np.arange(len(at)) - links[at]
                pairs, times = np.unique((a[at] * n_b + b[other]).astype(np.uint64) * U(j - i) + doc_a[at].astype(np.uint64), return_counts=True)
                pair, doc = pairs // U(j - i), pairs % U(j - i)
                bucket = _bucket_of(pair)
                order = np.argsort(bucket, kind="stable")
                pair, doc, times = pair[order], doc[order], times[order]
                cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
                full = [k for k in range(BUCKETS) if cuts[k] < cuts[k + 1]]
                part = lambda x: [_pack(x[cuts[k] : cuts[k + 1]]) for k in full]
                steps = [_pack(np.diff(pair[cuts[k] : cuts[k + 1]], prepend=U(0))) for k in full]
                yield _batch({"_ta_bucket": full, "_ta_first": [int(rows[0])] * len(full), "_ta_codes": steps, "_ta_docs": part(doc), "_ta_times": part(times)}, schema, len(full))

    return run


def _batch(columns: dict, schema: pa.Schema, n: int) -> pa.RecordBatch:
    full = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(full, schema, strict=True)], schema=schema)


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(at, np.concatenate(times)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["_ta_code", "_ta_n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs as sums by pair, over as many packs as fit."""
    codes, times, held = [], [], 0
    for batch in batches:
        for c, n in zip(batch.column("_ta_codes"), batch.column("_ta_times"), strict=True):
            codes.append(np.cumsum(_unpack(c.as_py()).astype(np.uint64)))
            times.append(_unpack(n.as_py()).astype(np.int64))
            held += len(codes[-1])
            if held >= SUMMED:
                yield _summed(codes, times)
                codes, times, held = [], [], 0
    if codes:
        yield _summed(codes, times)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, salt, kind): a bucket's counts, sorted by pair, then its packs, each summed up by document."""
    held, parts, table = None, [], ()
    for batch in batches:
        keys = list(zip(batch.column("_ta_bucket").to_pylist(), batch.column("_ta_salt").to_pylist(), strict=True))
        is_count = np.asarray(batch.column("_ta_code").is_valid())
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or is_count[k] != is_count[k - 1]], len(keys)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if keys[x] != held:
                held, parts, table = keys[x], [], ()
            rows = batch.slice(x, y - x)
            if is_count[x]:
                parts.append([np.asarray(rows.column(c).cast(pa.int64())) for c in ("_ta_code", "_ta_n", "_ta_best")])
                continue
            table = table or tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            code, n, best = table
            for first, c, d, t in zip(*[rows.column(k) for k in ("_ta_first", "_ta_codes", "_ta_docs", "_ta_times")], strict=True):
                at = np.searchsorted(code, np.cumsum(_unpack(c.as_py()).astype(np.uint64)).astype(np.int64))
                doc, times = _unpack(d.as_py()).astype(np.int64), _unpack(t.as_py()).astype(np.int64)
                seen, place = np.unique(doc, return_inverse=True)
                n_best, total = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
                np.add.at(n_best, place, times * best[at])
                np.add.at(total, place, times * n[at])
                yield pa.RecordBatch.from_arrays([pa.array(seen + first.as_py()), pa.array(n_best), pa.array(total)], ["_ta_row", "n_best", "count_sum"])


def pair_counts(packs: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best): links of each id pair in the corpus, and whether no pair of the same B id has more."""
    counts = packs.select("_ta_codes", "_ta_times").mapInArrow(giving_back(_count), "_ta_code bigint, _ta_n bigint").groupBy("_ta_code").agg(F.sum("_ta_n").alias("_ta_n"))
    counts = cut(counts)
    most = counts.groupBy((F.col("_ta_code") % n_b).alias("_ta_b")).agg(F.max("_ta_n").alias("_ta_most"))
    met = counts.withColumn("_ta_b", F.col("_ta_code") % n_b).join(most, "_ta_b")
    return met.select("_ta_code", "_ta_n", (F.col("_ta_n") == F.col("_ta_most")).cast("long").alias("_ta_best"))


def _bucket_of(code: np.ndarray) -> np.ndarray:
    return (mix(code.astype(np.uint64) + U(1)) % U(BUCKETS)).astype(np.int32)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("_ta_bucket", pa.array(_bucket_of(np.asarray(batch.column("_ta_code")))))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and the SHA-256 of its groups as text ('' without tokens)."""
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    # Row numbers are kept by the checkpoint behind them, so whatever runs again reads the same.
    work = docs.select(F.monotonically_increasing_id().alias("_ta_row"), F.col(id_col).alias("_ta_id"), F.col(text_col).alias("_ta_text"))
    made = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = [(name, made.get(kind)) for name, kind in (x.split() for x in FOUND.format(id="_ta_id own").split(", "))]
    found = cut(work.mapInArrow(giving_back(_align(a_path, b_path, kinds)), FOUND.format(id=f"_ta_id {work.dtypes[1][1]}")))
    stats, packs = found.filter("_ta_bucket is null"), found.filter("_ta_bucket is not null")
    packs = packs.select("_ta_bucket", "_ta_first", "_ta_codes", "_ta_docs", "_ta_times")
    size = packs.agg(F.sum(F.octet_length("_ta_codes") + F.octet_length("_ta_docs") + F.octet_length("_ta_times"))).head()[0] or 0
    salts = 1 + size // (BUCKETS * PACK_BYTES)
    counts = pair_counts(packs, _pieces(b_path)).mapInArrow(_dealt, "_ta_code bigint, _ta_n bigint, _ta_best bigint, _ta_bucket int")
    counts = counts.withColumn("_ta_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<int>")))
    packs = packs.withColumn("_ta_salt", F.pmod(F.xxhash64("_ta_first"), F.lit(salts)).cast("int"))
    line = packs.unionByName(counts, allowMissingColumns=True).repartition(BUCKETS * salts, "_ta_bucket", "_ta_salt")
    line = line.sortWithinPartitions("_ta_bucket", "_ta_salt", F.col("_ta_code").asc_nulls_last())
    sums = line.mapInArrow(giving_back(_look_up), "_ta_row bigint, n_best bigint, count_sum bigint").groupBy("_ta_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = stats.join(sums, "_ta_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("_ta_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _pieces(b_path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_path).get_piece_size()
