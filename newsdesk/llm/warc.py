"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is a request, a response (or a revisit that refers to the response with an equal payload) and a
metadata record. The request and the metadata name the response in WARC-Concurrent-To; assemble() joins the
three through it and emits one nested row per capture. Archives are written by Spark's own text writer - one
gzip stream of records per file, about FILE_BYTES and at most RECORDS_PER_FILE records - so they land wherever
Spark can write, and are read as whole files and cut by Content-Length, never by looking for separators in payloads.
A file holds one page at least, and a page must fit into a row of Spark's file reader (2 GB).

Cases: null html is an empty payload; rows that repeat a page_id with the same payload are one capture, and with
another payload one of its own; rows without a page_id are responses, one for each payload; null urls are written
empty; line breaks in urls are percent-encoded; of equal payloads the smallest page_id is the response; an empty
table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.arrays import tidy
from newsdesk.llm.tables import new_path, stored

#: Bytes of payloads in a file, about, and records at most.
FILE_BYTES, RECORDS_PER_FILE = 128 << 20, 6_000
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the UTF-8 bytes."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _record(kind: Column, rid: Column, headers: list[tuple[str, Column]], content_type: str, block: Column, date: str) -> Column:
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), rid, F.lit(f">\r\nWARC-Date: {date}")]
    for name, value in headers:
        lines += [F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit(""))]
    lines += [F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n")]
    return F.concat(*lines)


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as archives in the folder `path`.

    Of records with equal payloads of at least min_bytes, that with the smallest page_id is the response."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    p = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    # ids and digests only: a payload that a third of the rows share meets as one row of each task, and pages are dealt
    # by their own ids
    small = p.select("page_id", "digest", "n").distinct()
    first = small.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    later = small.join(first, "digest").where("first_id < page_id").select("page_id", "digest", "first_id")
    size = p.agg(F.sum("n")).first()[0] or 0
    p = p.repartition(max(1, int(size) // FILE_BYTES + 1), "page_id", "digest").join(later, ["page_id", "digest"], "left")
    revisit = F.coalesce(F.col("first_id") < F.col("page_id"), F.lit(False))
    rid = _record_id("response", F.col("page_id"), F.col("digest"))
    uri = ("WARC-Target-URI", F.col("url"))
    together = ("WARC-Concurrent-To", F.concat(F.lit("<"), rid, F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    response = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        rid,
        [
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), _record_id("response", F.col("first_id"), F.col("digest")), F.lit(">")))),
        ],
        "application/http;msgtype=response",
        http,
        date,
    )
    request = _record(F.lit("request"), _record_id("request", F.col("page_id"), F.col("digest")), [uri, together], "application/http;msgtype=request", F.lit("GET / HTTP/1.1\r\n\r\n"), date)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), _record_id("metadata", F.col("page_id"), F.col("digest")), [uri, together], "application/warc-fields", fields, date)
    records = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # each value ends with one line break and the writer adds the second that closes a record
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        if end + 4 + n + 4 > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


RECORDS = "kind string, record_id string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string, fields string, payload string"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record. Size and digest of a stored payload are those of the bytes that were read; a payload that
    does not match its recorded digest stops the job. Without with_payload the payload column is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows: list[tuple] = []
                for headers, block in parse_records(data):
                    kind = headers["warc-type"]
                    size = digest = fields = body = None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            size = len(payload)
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if found != digest:
                                raise ValueError(f"{headers['warc-record-id']}: payload digest {found}, recorded {digest}")
                            body = payload.decode() if with_payload else None
                        else:
                            size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    elif kind == "metadata":
                        fields = block.decode()
                    bare = [headers.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri")]
                    rows.append((kind, *bare, size, digest, fields, body))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(tidy(run), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata structs (request and metadata may be null).

    Record ids are unique in an archive, so repeated records are one."""

    def side(kind: list[str], key: str, name: str, *columns: str) -> DataFrame:
        return records.where(F.col("kind").isin(kind)).dropDuplicates([key]).select(F.col(key).alias("capture_id"), F.struct(*columns).alias(name))

    response = side(["response", "revisit"], "record_id", "response", "kind", "uri", "payload_bytes", "payload_digest", "refers_to", "payload")
    request = side(["request"], "concurrent_to", "request", "record_id", "uri")
    metadata = side(["metadata"], "concurrent_to", "metadata", "record_id", "fields")
    return response.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def op10_warc(spark, sf_dir):
    from newsdesk.llm.tables import read

    path = new_path(spark, "warc")
    write_captures(read(spark, sf_dir, "pages"), path)
    captures = assemble(stored(read_records(spark, path, with_payload=False), "records"))
    page_id = F.expr("try_cast(regexp_extract(metadata.fields, 'page-id: ([-0-9]*)', 1) as bigint)")
    flat = captures.select("capture_id", page_id.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("refers_id"))
    # the response of a group of equal payloads, by the record id that its revisits name; only revisits look for one
    named = flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    again = flat.where("record_type = 'revisit'").join(named, "refers_id", "left").drop("refers_id", "capture_id")
    return flat.where("record_type = 'response'").drop("refers_id", "capture_id").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha1(h) as s from p),
g as (select *, min(page_id) over (partition by s) as f from d),
b as (select *, unnest(range(0, 4)) as k from g),
c as (select page_id, any_value(n) as n, any_value(f) as f,
  string_agg(list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(s, 1 + 10 * k, 10) as bigint) >> (35 - 5 * j)) & 31 as bigint) + 1, 1) for j in range(0, 8)], 'string_agg', ''), '' order by k) as t
  from b group by page_id)
select page_id, cast(n as bigint) as payload_bytes, t as payload_digest,
  case when f = page_id then 'response' else 'revisit' end as record_type,
  case when f = page_id then null else f end as refers_to
from c
"""
