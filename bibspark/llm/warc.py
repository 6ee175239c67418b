"""Operator 10, WARC archives as a chunked record table.

An archive is a table of rows (archive, record, chunk, data, ...): the data of a record's chunks, joined in order, are
its bytes in WARC 1.1 form, and the chunks of an archive, joined in order, are a WARC file. Payloads are cut into
chunks as they are written and are digested chunk by chunk as they are read; no step needs a whole record at once
beyond the row that the input itself holds. Each chunk carries the digest of the payload up to its end.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, join_sliced, materialize, small, table

CHUNK_BYTES, MIN_REVISIT_BYTES = 1 << 20, 0
CHUNK_SCHEMA = "page_id long, archive int, record long, chunk int, last boolean, data binary, sha1_so_far binary"
#: Rows that are handed on together hold about so many bytes.
BATCH_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with their payload and refers_to: null for a response, else the smallest page_id of equal payload.

    Payloads are equal if SHA-1 and length are. Counting is combined per task, so a payload that fills a third of the
    table costs a row a task; only digests are shuffled for it. Pages then meet the repeated digests, which are broadcast
    if they are small; else pages of a digest with very many are dealt over slices. Pages without an id are responses of
    their own; of rows that repeat the smallest id of a payload, all are responses.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).alias("bytes"))
    firsts = base.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = materialize(firsts.where(f"n > 1 and bytes >= {min_bytes}").select(F.struct("sha1", "bytes").alias("payload"), "first_id", "n"), "repeated")
    base = base.withColumn("payload", F.struct("sha1", "bytes"))
    few = small(repeated.select("payload", "first_id"))
    if repeated.count() <= BROADCAST_ROWS:
        joined = base.join(few, "payload", "left")
    else:
        once = base.join(few, "payload", "left_anti").withColumn("first_id", F.lit(None).cast("long"))
        joined = join_sliced(base, few, "payload", "page_id", counts=repeated.select("payload", F.col("n").alias("rows"))).select(*once.columns).unionByName(once)
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def header(kind: str, page_id: int | None, url: str, digest: bytes, length: int, refers_to: int | None) -> bytes:
    clean = "".join(c for c in url if c.isprintable() and c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32(digest)}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if refers_to is not None else length}", "", ""]
    return "\r\n".join(lines).encode()


def payload_digest(html: str, step: int = CHUNK_BYTES) -> tuple[bytes, int]:
    """SHA-1 and bytes of a payload, encoded and digested a slice at a time."""
    sha, n = hashlib.sha1(), 0
    for i in range(0, len(html), step):
        part = html[i : i + step].encode("utf-8", "replace")
        sha.update(part)
        n += len(part)
    return sha.digest(), n


def write_records(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all records; a partition is an archive. A record's first chunk starts with its header, its last
    ends with the blank lines; a revisit has no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, text, refers = page_id.as_py(), html.as_py(), refers_to.as_py()
                digest, length = payload_digest(text, chunk_bytes)
                sha, data, chunk = hashlib.sha1(), header("response" if refers is None else "revisit", page_id, url.as_py(), digest, length, refers), 0
                for i in range(0, len(text), chunk_bytes) if refers is None else ():
                    part = text[i : i + chunk_bytes].encode("utf-8", "replace")
                    sha.update(part)
                    last = i + chunk_bytes >= len(text)
                    rows.append((page_id, archive, number, chunk, last, data + part + b"\r\n\r\n" * last, sha.copy().digest()))
                    held += len(part)
                    data, chunk = b"", chunk + 1
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if data:
                    rows.append((page_id, archive, number, chunk, True, data + b"\r\n\r\n", sha.digest()))
                    held += len(data)
                number += 1
        if rows:
            yield _batch(rows)

    return planned.mapInArrow(run, CHUNK_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "archive", "record", "chunk", "last", "data", "sha1_so_far"])


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Reader:
    """Parses one record from its chunks, in order, keeping only the header and a running digest."""

    def __init__(self) -> None:
        self.head, self.fields, self.sha, self.left, self.n = b"", None, hashlib.sha1(), 0, 0

    def feed(self, data: bytes, sha1_so_far: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.head[:at].decode("utf-8", "replace").split("\r\n")
            self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.left, data, self.head = int(self.fields["Content-Length"]), self.head[at + 4 :], b""
        part = data[: self.left]
        self.sha.update(part)
        self.left -= len(part)
        self.n += len(part)
        if self.fields["WARC-Type"] == "response" and self.sha.digest() != sha1_so_far:
            raise ValueError(f"damaged chunk in record {self.fields['WARC-Record-ID']}")

    def result(self) -> tuple:
        f = self.fields
        number = lambda k: int(x) if (x := f.get(k, "")[len("<urn:page:") : -1]) else None
        stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if self.left or f["WARC-Type"] == "response" and stated != base32(self.sha.digest()):
            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
        return number("WARC-Record-ID"), int(f["X-Payload-Length"]) if f["WARC-Type"] == "revisit" else self.n, stated, f["WARC-Type"], number("WARC-Refers-To")


def read_records(chunks: DataFrame) -> DataFrame:
    """What the records say, from the archives' bytes alone. Chunks of a record may come from anywhere: they are dealt
    out by archive and record and sorted by chunk, so many records share a task but none is held whole."""
    ordered = chunks.select("archive", "record", "chunk", "last", "data", "sha1_so_far").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return ordered.mapInArrow(read_run, READ_SCHEMA)


def read_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        out = []
        for last, data, so_far in zip(*(batch.column(c) for c in ("last", "data", "sha1_so_far")), strict=True):
            reader.feed(data.as_py(), so_far.as_py())
            if last.as_py():
                out.append(reader.result())
                reader = Reader()
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive_pages(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The written chunk table, in the shared folder. Rows with null html have an empty payload."""
    bounded_batches(pages.sparkSession)
    return materialize(write_records(plan_records(pages, min_bytes), chunk_bytes), "warc")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(archive_pages(table(spark, sf_dir, "pages")))


#: DuckDB has no base32; five bits at a time from the hex digits.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: right(bin(('0x' || substr(h, i + 1, 1))::INT + 16), 4)), 'string_agg', '') AS bits FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * (1 << (4 - j))))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b
"""
