"""Operator 1: WARC archives with revisit records for payloads that are already there.

Headers alone are shuffled by payload digest: (digest, record) pairs of payloads long enough to count. The response
of a digest is the record with the largest id, found by a pre-aggregated maximum; revisits are joined to it, and
that join's hot digests can be split. Decisions are joined to the pages by record and digest: where there are too many
revisits for Spark to broadcast, that join shuffles the pages with their payloads once. The archives are written
with fresh headers by Spark's own text writer, whose line separator is the end of a WARC record, so that
writes are committed per task and any store will do. Reading parses by Content-Length.

Records: a response's block is an HTTP header and the payload; a revisit's is the HTTP header alone (profile
identical-payload-digest), whose Content-Length is that of the payload it leaves out.

Defined cases: a null payload is empty; a null or unprintable url makes no or an escaped WARC-Target-URI; a null
page_id never is a response for others and is kept as a response; rows that share page_id and payload get one
verdict (the largest id's are all responses); an empty table makes an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(record_id, digest, refers_to) of the revisits among headers (record_id, digest, n_bytes): those whose digest a larger record_id has too."""
    counted = headers.filter(F.col("n_bytes") >= least_bytes).filter("record_id IS NOT NULL")
    first = counted.groupBy("digest").agg(F.max("record_id").alias("refers_to"), F.min("record_id").alias("low"))
    first = written(first.filter("low < refers_to").drop("low"), "responses")
    return counted.join(first, "digest").filter("record_id < refers_to").select("record_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, date: datetime | None = None) -> None:
    """One record for each row of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("record_id"), "url", payload.alias("payload"))
    pages = pages.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    revisits = resolve_revisits(pages.select("record_id", "digest", "n_bytes"), least_bytes)
    pages = pages.join(written(revisits, "revisits"), ["record_id", "digest"], "left")
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    # Escaped: what would end or break the header line.
    uri = F.col("url")
    for c in "\r\n\t ":
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("record_id")),
        F.lit(f"\r\nWARC-Date: {when}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), http,
    )
    record = F.concat(head.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    pages.select(record.cast("string").alias("value")).write.options(lineSep=END, compression="gzip").text(folder)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream; one record is held at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[key.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"truncated record {headers.get('warc-record-id')}")
        yield headers, block


class _Inflated(io.RawIOBase):
    """Gzip bytes (one member or several) as a stream, without inflating all of them at once."""

    def __init__(self, data):
        self.data, self.at, self.z = memoryview(data), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            tail = self.z.unconsumed_tail
            if not tail:
                if self.z.eof:
                    self.at -= len(self.z.unused_data)
                    self.z = zlib.decompressobj(31)
                tail = self.data[self.at : self.at + (1 << 16)]
                self.at += len(tail)
                if not len(tail):
                    return 0
            some = self.z.decompress(tail, len(out))
            if some:
                out[: len(some)] = some
                return len(some)


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(urn: str | None) -> int | None:
        return None if urn in (None, "<urn:page:none>") else int(urn[len("<urn:page:") : -1])

    for batch in batches:
        for data in batch["content"]:
            rows = []
            for headers, block in records(io.BufferedReader(_Inflated(data.as_buffer()), 1 << 17)):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                n = int(http.rpartition(b"Content-Length:")[2])
                if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, kind, number(headers.get("warc-refers-to"))))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of gzipped archives."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_record_rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
