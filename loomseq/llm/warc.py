"""A content-addressed web archive.

An archive is two tables. ``headers`` has a row per record: its exact header
bytes and its payload's SHA-256. ``payloads`` has each distinct payload once,
deflated, by that digest. A record is rebuilt by a join on the digest, and a
payload whose bytes don't have its digest stops the job. A payload of MIN_REVISIT
bytes or more is in one response record, that with the least page_id; the
records of other pages revisit it.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, delete_path, settled, shared_path, slices, trimmed

#: The least payload that is worth a revisit; digests that a task remembers having had.
MIN_REVISIT, SEEN = 100, 200_000
DATE = "2024-01-01T00:00:00Z"
#: WARC 1.1 names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


@trimmed
def _packed(batches):
    """Digest of each payload, and the payload deflated where this task hasn't had it yet; a few may come again."""
    seen: set[bytes] = set()
    for batch in batches:
        for b in slices(batch):
            payloads = [x or b"" for x in byte_rows(b.column(2))]
            digests = [hashlib.sha256(x) for x in payloads]
            new = [d.digest() not in seen and not seen.add(d.digest()) for d in digests]
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([len(x) for x in payloads], pa.int64()),
                    pa.array([d.hexdigest() for d in digests], pa.string()),
                    pa.array([zlib.compress(x, 1) if n else None for x, n in zip(payloads, new)], pa.binary()),
                ],
                ["page_id", "url", "payload_bytes", "digest", "packed"],
            )


def _header(kind, record, url, length, digest, refers) -> F.Column:
    """Header bytes; control characters in a URL, which would end its line, are percent-encoded.

    record and refers are structs of a page's id and the record's number,
    which makes it the only one with that name.
    """
    name = lambda x: F.concat(F.lit("<" + ID), F.coalesce(x["page_id"].cast("string"), F.lit("null")), F.lit(":"), x["n"].cast("string"), F.lit(">"))
    safe = F.coalesce(url.cast("string"), F.lit(""))
    for c in ("\r", "\n"):
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    revisit = kind == "revisit"
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(record)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(refers))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(length).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as path/headers and path/payloads.

    Null html is an empty payload, a null url an empty one. Repeated rows get
    a record each, with a name of its own; those of the least page_id are all
    responses. Other columns are not in the archive, and an empty table makes
    an empty one. One pass over html makes a table of digests and deflated
    payloads, from which the two tables come; it is deleted then.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.col("html").cast("string"), "UTF-8").alias("payload"))
    packed = rows.mapInArrow(_packed, f"page_id {kind}, url string, payload_bytes long, digest string, packed binary")
    packed.withColumn("n", F.monotonically_increasing_id()).write.parquet(f"{path}/made")
    made = spark.read.parquet(f"{path}/made")
    made.where("packed is not null").select("digest", "packed").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")
    record = F.struct("page_id", "n")
    first = made.where((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(record).alias("first"))
    first = settled(first)  # so that Spark can split the join on a payload that many pages have
    slim = made.drop("packed").join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    header = _header(F.when(again, "revisit").otherwise("response"), record, F.col("url"), F.col("payload_bytes"), F.col("digest"), F.col("first"))
    slim.select(header.alias("header"), "digest").write.parquet(f"{path}/headers")
    delete_path(spark, f"{path}/made")


@trimmed
def _joined(batches):
    for batch in batches:
        for b in slices(batch):
            headers, digests, packed = byte_rows(b.column(0)), b.column(1).to_pylist(), byte_rows(b.column(2))
            records, payloads = [], []
            for header, digest, z in zip(headers, digests, packed):
                payload = zlib.decompress(z)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"stored payload {digest} has other bytes")
                payloads.append(payload)
                block = b"" if b"\r\nWARC-Type: revisit\r\n" in header else payload
                records.append(header + block + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (headers, records, payloads)], ["header", "record", "payload"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, record, payload): each record's exact bytes, and the full payload that it has or refers to."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    held = headers.join(payloads, "digest", "left").select("header", "digest", "packed")
    return held.mapInArrow(_joined, "header binary, record binary, payload binary")


def parsed(records: DataFrame) -> DataFrame:
    """records with header fields: page_id, url, record_type, refers_to, digest."""
    field = lambda name, rest=r"([^\r]*)": F.regexp_extract(F.col("head"), rf"\r\n{name}: {rest}", 1)
    rows = records.withColumn("head", F.decode("header", "UTF-8"))
    page = field("WARC-Record-ID", rf"<{ID}(-?\d+):\d+>").try_cast("long")
    refers = field("WARC-Refers-To", rf"<{ID}(-?\d+):\d+>").try_cast("long")
    return rows.select(
        page.alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        refers.alias("refers_to"),
        field("WARC-Payload-Digest", r"sha256:([0-9a-f]*)").alias("digest"),
        "record",
        "payload",
    )


def op3_warc_content_addressed(pages: DataFrame) -> DataFrame:
    path = shared_path(pages.sparkSession, "archive")
    write_archive(pages, path)
    rows = parsed(read_archive(pages.sparkSession, path))
    return rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.*, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
