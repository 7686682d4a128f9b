"""WARC: a content-addressed archive. Payload bytes are stored once by a verified digest, exact record headers apart, and records come back by joins."""

from __future__ import annotations

import atexit
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop
from .common import scratch_path, table

#: Equal payloads of at least so many bytes are stored by one response and revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header", pa.string())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _safe(url: Column) -> Column:
    """A url in one header line: percent-encode what would end the line."""
    url = F.coalesce(url, F.lit(""))
    for c, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(c), F.lit(code))
    return url


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write path/payloads (digest, bytes, sha1, payload: each different payload once) and path/headers (page_id, url, digest,
    record_type, header: the exact header block of each record; url as it came, since a header line holds it without line ends).

    pages: page_id, url, html. Null html: an empty payload; null url: an empty target; null page_id: a record of its own that
    is never referred to while another has an id. Of equal payloads of at least revisit_bytes, the largest page_id is the response (rows that repeat it
    as well), the others revisit it. A record's id is made of the archive, its page_id and its payload, so the id that a revisit refers to
    is the response's; rows that repeat page_id and html are the same record and have the same id. Payload bytes travel once per partition at most, since copies are merged before the
    exchange; headers are joined to digests alone, so that a hot payload is a hot key of small rows that AQE may split.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("top"), F.count("*").alias("n"))
    payloads = payloads.select("digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), "top", "n", "payload")
    payloads.write.parquet(f"{path}/payloads")
    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "bytes", "sha1", "top", "n")
    heads = rows.select("page_id", "url", "digest").join(known, "digest")
    archive = uuid.uuid4().hex
    again = (F.col("bytes") >= revisit_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    kind = F.when(again, "revisit").otherwise("response")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex("digest")), F.lit(f":{archive}>"))
    ident, refers = name("page_id"), F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("top"), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise("")
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), ident, F.lit("\r\nWARC-Target-URI: "), _safe(F.col("url")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n"), refers,
                      F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(again, 0).otherwise(F.col("bytes")).cast("string"), F.lit("\r\n\r\n"))
    heads.select("page_id", "url", "digest", kind.alias("record_type"), header.alias("header")).write.parquet(f"{path}/headers")


def records(spark: SparkSession, path: str, resolve: bool = False) -> DataFrame:
    """page_id, record_type, record (binary): each record's exact bytes, its header joined with its payload. With resolve, a revisit brings the
    payload that it refers to. A payload that no longer has its strong digest stops the read."""
    h, p = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    fine = F.assert_true(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.lit("a stored payload has changed")).isNull()
    out = h.join(p.where(fine).select("digest", "payload"), "digest")
    body = F.when((F.col("record_type") == "response") | F.lit(resolve), F.col("payload")).otherwise(F.unhex(F.lit("")))
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return out.select("page_id", "record_type", F.concat(F.encode("header", "UTF-8"), body, end).alias("record"))


def parse(data: bytes, bodies: bool = True) -> list[tuple[dict, bytes]]:
    """Headers and payload of each record in the bytes of a WARC file, gzipped or not; without bodies, of headers alone."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    f, out = io.BytesIO(data), []
    while line := f.readline():
        if not line.strip():
            continue
        head = {"version": line.strip().decode()}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip()] = v.strip()
        out.append((head, f.read(int(head.get("Content-Length", 0))) if bodies else b""))
    return out


def one_record(data: bytes) -> tuple[dict, bytes]:
    """Headers of a record and all bytes that it brings, whatever its Content-Length: a resolved revisit brings a payload."""
    at = data.index(b"\r\n\r\n") + 4
    return parse(data[:at], bodies=False)[0][0], data[at:-4]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, header. Each record is put together from its header and
    the payload that it has or refers to, and parsed: names come from its header fields, bytes and SHA-1 from its payload. A
    payload without its strong digest, or a header that names another SHA-1 or length, stops the read."""

    def number(urn):
        found = re.match(r"<urn:page:(-?\d+):", urn or "")
        return int(found[1]) if found else None

    def rows(batches):
        for b in batches:
            out = []
            for data in b.column(0).to_pylist():
                head, body = one_record(data)
                sha = hashlib.sha1(body).hexdigest()
                if head.get("WARC-Payload-Digest") != f"sha1:{sha}":
                    raise ValueError(f"a header names another digest: {head.get('WARC-Record-ID')}")
                if head["WARC-Type"] == "response" and int(head["Content-Length"]) != len(body):
                    raise ValueError(f"a header names another length: {head.get('WARC-Record-ID')}")
                out.append((number(head["WARC-Record-ID"]), len(body), sha, head["WARC-Type"], number(head.get("WARC-Refers-To")), data[: len(data) - len(body) - 4].decode()))
            yield pa.RecordBatch.from_pylist([dict(zip(READ.names, r, strict=True)) for r in out], READ)

    return records(spark, path, resolve=True).select("record").mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, header string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (one file a task row; .gz members are read through): file, record_type, record_id, target_uri, payload_digest, refers_to, payload."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            for name, data in zip(b.path, b.content, strict=True):
                for h, body in parse(bytes(data)):
                    yield pd.DataFrame([[name, *(h.get(k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To")), body]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    atexit.register(drop, spark, path)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM p
"""
