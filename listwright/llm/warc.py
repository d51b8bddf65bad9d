"""Operator 1: a content-addressed web archive.

`write_archive` keeps two tables: `records` (one row per page: the exact bytes of the WARC and HTTP headers and the
payload's key) and `payloads` (each distinct payload once, under its SHA-256). `read_archive` joins the two, rebuilds
every record, checks both digests and parses the rebuilt bytes. `parse_warc` reads plain WARC bytes from binary files.

Defined results. A null html is an empty payload; a null url gives no WARC-Target-URI line; pages with a null page_id
are archived too and never outrank one with an id. Repeated rows of one page_id: one of them is the response only if
its page_id is the largest of its payload, and then each of them is one. An empty table gives empty tables. Columns
beyond page_id, url and html are ignored. Payloads of any length are one value each, up to the 2 GB of a column's value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BASE32_OF_CONV = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
FIXED_DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: four groups of 40 bits, eight letters each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), *BASE32_OF_CONV)


def write_archive(pages: DataFrame, date: str = FIXED_DATE) -> tuple[DataFrame, DataFrame]:
    """(records, payloads), both written to the shared folder.

    Only (page_id, key) is shuffled to choose the response of each payload. Payloads go through one exchange by key, of
    which each keeps one row: rows of a key have the same bytes, so any of them will do. A payload's key that holds many pages is a skewed join that AQE splits: both
    sides are read from tables, so neither is pre-partitioned.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select("page_id", "url", html.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    chosen = written(page.groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("n_pages")), "warc-chosen")
    meta = page.select(
        "page_id", "url", "key", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")
    )
    linked = meta.join(chosen, "key")
    is_response = F.col("page_id").eqNullSafe(F.col("holder"))

    def record_id(c: str) -> Column:
        h = F.md5(F.concat(F.lit("page:"), F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("binary"))
        parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    http = F.concat(F.lit(HTTP_HEAD), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    body = F.octet_length(http) + F.when(is_response, F.col("n")).otherwise(F.lit(0))
    url = F.regexp_replace("url", r"[\r\n]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(is_response, F.lit("response")).otherwise(F.lit("revisit")),
        F.concat(F.lit("\r\nWARC-Record-ID: "), record_id("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), url)),
        F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string")),
        F.concat(F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(is_response, F.lit("")).otherwise(
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.concat(F.lit("\r\nWARC-Refers-To: "), record_id("holder")),
                F.concat(F.lit("\r\nX-Refers-To-Page: "), F.coalesce(F.col("holder").cast("string"), F.lit(""))),
            )
        ),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        body.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )
    records = written(
        linked.select("page_id", "key", is_response.alias("has_payload"), head.cast("binary").alias("header")), "warc-records"
    )
    payloads = written(page.dropDuplicates(["key"]).select("key", "payload"), "warc-payloads")
    return records, payloads


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record rebuilt (header, payload of responses, closing blank lines) and parsed.

    A response whose payload doesn't have the key's SHA-256, the header's SHA-1 or the header's length fails the job.
    Only responses meet payloads, one to one, so a payload that many pages share isn't copied.
    """
    whole = records.where("has_payload").join(payloads, "key")
    end, at = F.lit("\r\n\r\n").cast("binary"), F.octet_length("header").alias("at")
    whole = whole.select("key", F.concat("header", "payload", end).alias("record"), at, F.lit(True).alias("response"))
    bare = records.where("not has_payload")
    bare = bare.select("key", F.concat("header", end).alias("record"), at, F.lit(False).alias("response"))
    return parsed(whole).unionByName(parsed(bare))


def parsed(whole: DataFrame) -> DataFrame:
    head = F.decode(F.expr("substring(record, 1, at)"), "UTF-8")
    payload = F.expr("substring(record, at + 1, octet_length(record) - at - 4)")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", f"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))

    rows = whole.select("*", head.alias("head"), payload.alias("payload"))
    digest = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    length = field("X-Payload-Length").cast("long")
    good = ~F.col("response") | (
        (F.unhex(F.sha2("payload", 256)) == F.col("key")) & (base32_sha1(F.col("payload")) == digest) & (F.octet_length("payload") == length)
    )
    kind = F.regexp_extract("head", "^WARC/1.1\r\nWARC-Type: (\\w+)", 1)
    return rows.select(
        field("X-Page-Id").cast("long").alias("page_id"),
        F.when(good, length).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")).cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        kind.alias("record_type"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
    )


def with_payloads(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, header, payload) of every record, revisits included. AQE splits a payload that many pages share."""
    return records.join(payloads, "key").select("page_id", "header", "payload")


def parse_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files below `path`: (file, record, header, block)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, out = 0, []
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
                    size = next((int(x.split(":", 1)[1]) for x in lines if x.lower().startswith("content-length:")), 0)
                    out.append((name, len(out), data[at : end + 4], data[end + 4 : end + 4 + size]))
                    at = end + 4 + size + 4
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    names=["file", "record", "header", "block"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, "file string, record long, header binary, block binary")
