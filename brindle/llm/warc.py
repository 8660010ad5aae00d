"""WARC archives of web pages and their capture index.

Writing: pages are joined to the smallest page_id of their payload's digest; that page
becomes a ``response`` record with the payload, the others ``revisit`` records that refer
to it. One record is one row of Spark's text writer, whose line separator is the CRLF pair
that ends a WARC record, so archives go to any store and obey Spark's commit protocol.

Reading: archives are read as a stream of pieces between CRLF pairs, from which records are parsed
by Content-Length, so memory holds a batch and one record, not an archive. Every archive (of at most
``RECORDS_PER_FILE`` captures) yields a run of captures sorted by URL key, timestamp and page_id. Runs are
then dealt by ranges of that order, of about ``RANGE_ROWS`` captures, and each range's slices of
the runs are merged by a loser tree: an external k-way merge whose output is in global order.

Defined results: null html is an empty payload; payloads below ``min_revisit_bytes`` are
never revisits; repeated rows of the smallest page_id are all responses; a null page_id counts
as larger than any other and as itself null in ``refers_to``; a null url is the empty URL; an
empty table gives an empty index; pages of any length are written and read whole; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_path

RECORDS_PER_FILE, RANGE_ROWS = 5000, 200_000
END = "\r\n\r\n"
MARK = END.encode()
#: Digits of Spark's base 32 and of RFC 4648.
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "urlkey string, ts string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, file string, offset bigint, length bigint"


def digest32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, JVM-side: ten hex digits at a time are eight base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_FROM, BASE32_TO)


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(record) texts without their final CRLF pair."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), digest32(html).alias("digest"))
    # The smallest page of each digest is found by partial aggregation; the join that brings it
    # back has one row on that side, so AQE can split a digest that holds many pages.
    first = p.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"))).alias("first"))
    p = p.join(first, "digest")
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.id"))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 30))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END), F.col("html"))
    body = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(block)
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number(F.col("page_id")), F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), number(F.col("first.id")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END), F.col("body"),
    ]
    return p.withColumn("body", body).select(F.concat(*head).alias("record"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Archives under ``path``, each a gzip file of one member; offsets of the index are those inside it."""
    writer = records(pages, min_revisit_bytes).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, no scheme, www or fragment, lower case host."""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.lower().removeprefix("www.").split(":")[0]
    return ",".join(reversed(host.split("."))) + ")/" + path if slash or host else ""


def _number(text: str) -> int | None:
    value = text.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def captures(pieces: Iterator[bytes], file: str) -> Iterator[tuple]:
    """The captures of one archive, given as pieces between CRLF pairs, in file order. Digests and sizes of payloads are taken anew."""
    held, start = bytearray(), 0
    for piece in pieces:
        held += piece
        held += MARK
        while (head_end := held.find(MARK)) >= 0:
            head = dict(line.split(": ", 1) for line in held[:head_end].decode().split("\r\n")[1:])
            if "Content-Length" not in head:  # what is left behind the last record
                return
            body = head_end + len(MARK)
            end = body + int(head["Content-Length"])
            if len(held) < end + len(MARK):
                break
            digest, size = head["WARC-Payload-Digest"].partition(":")[2], int(head["X-Payload-Length"])
            if head["WARC-Type"] == "response":
                payload = memoryview(held)[held.index(MARK, body) + len(MARK) : end]
                digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                payload.release()
            ts = "".join(c for c in head["WARC-Date"] if c.isdigit())
            url = head["WARC-Target-URI"]
            refers = _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
            yield url_key(url), ts, _number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, url, file, start, end
            del held[: end + len(MARK)]
            start += end + len(MARK)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of captures of archives whose pieces (file, piece) come one archive after the other."""
    rows = ((f, piece) for b in batches for f, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True))
    for file, pieces in groupby(rows, key=lambda r: r[0]):
        run = sorted(captures((p.as_py() for _, p in pieces), file), key=_order)
        yield _table([(*r, i) for i, r in enumerate(run)], [*NAMES, "seq"], [*KINDS, pa.int64()])


def merge_runs(runs: list[list], key) -> Iterator:
    """Loser tree: inner nodes keep the losers of the matches, the winner goes out and its run's next row replays."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k
    head = [(0, key(r[0])) if r else (1, ()) for r in runs]  # a run that is over loses to any other
    tree = [0] * k
    winner = list(range(k))  # winners of the matches, as leaves k..2k-1 and inner nodes 1..k-1
    won = [0] * k + winner
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], tree[node] = (a, b) if head[a] <= head[b] else (b, a)
    best = won[1] if k > 1 else 0
    while head[best][0] == 0:
        yield runs[best][at[best]]
        at[best] += 1
        head[best] = (0, key(runs[best][at[best]])) if at[best] < len(runs[best]) else (1, ())
        node = (best + k) // 2
        while node:
            if head[tree[node]] < head[best]:
                tree[node], best = best, tree[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its rows come sorted by (file, seq), that is run by run; they are merged. Only keys are Python objects."""
    rows = pa.Table.from_batches(list(batches), pa.schema(list(zip(NAMES, KINDS, strict=True)))).combine_chunks()
    keys = [(u, t, p is None, p or 0, f, o) for u, t, p, f, o in zip(*(rows[n].to_pylist() for n in ("urlkey", "ts", "page_id", "file", "offset")), strict=True)]
    firsts = [i for i in range(len(keys)) if not i or keys[i][4] != keys[i - 1][4]]
    runs = [range(a, b) for a, b in zip(firsts, [*firsts[1:], len(keys)], strict=True)]
    for some in batched(merge_runs(runs, keys.__getitem__), 10_000):
        yield from rows.take(pa.array(some, pa.int64())).to_batches()


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives under ``path`` (schema ``INDEX``), partition by partition in global order."""
    text = spark.read.option("lineSep", END).text(path)
    runs = text.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary")).mapInArrow(_runs, f"{INDEX}, seq bigint")
    files = spark.read.format("binaryFile").load(path).select("path").count()  # lists them, reads none
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files * RECORDS_PER_FILE // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id").sortWithinPartitions("file", "seq")
    return dealt.drop("seq").mapInArrow(_merge, INDEX)


def histories(index: DataFrame) -> DataFrame:
    """One row per URL key: number of captures, of distinct payloads, first and last timestamp."""
    return index.groupBy("urlkey").agg(F.count(F.lit(1)).alias("captures"), F.count_distinct("payload_digest").alias("payloads"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def archive_and_index(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``path`` (a fresh shared folder by default) and read them back."""
    path = path or shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return capture_index(pages.sparkSession, path)
