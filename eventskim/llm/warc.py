"""Deduplicated WARC archives: one response for each payload, revisits for its copies.

Headers alone are grouped by payload digest; the pages are joined to the groups that
have copies and written with fresh headers. An archive part is gzipped WARC 1.1, read
back record by record by its lengths.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .common import fixed

LEAST_BYTES = 1000
RECORDS_PER_FILE = 4000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def resolve_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is
    the response (all its rows, if the row is repeated). NULL html is an empty payload,
    a NULL page_id is below all others; if a group has no other, all are responses.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(
        "page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    copies = (
        pages.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("__digest"))
        .agg(F.max("page_id").alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1 AND __first IS NOT NULL")
        .drop("__n")
    )
    # Stored, so that a hot digest's pages can be split in the join.
    copies = fixed(copies)
    revisit = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("page_id"))
    return (
        pages.join(copies, F.col("payload_digest") == F.col("__digest"), "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("__first")))
        .drop("__digest", "__first")
    )


def _field(name: str, value: Column) -> Column:
    """A header line; nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record(date: str = "2020-01-01T00:00:00Z") -> Column:
    """The WARC record of a row of :func:`resolve_revisits`, without the closing lines."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, "").otherwise(F.col("html"))
    length = F.octet_length(http) + F.octet_length(body)
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", target),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        length.cast("string"), F.lit("\r\n\r\n"), http, body,
    )


def write_archives(resolved: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write gzipped archive parts of up to ``per_file`` whole records below ``path``."""
    resolved.select(record().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", per_file
    ).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an unpacked archive."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        headers = {}
        for line in archive[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            headers[name.lower()] = value
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, archive[start:stop]
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = stop + 4


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            for headers, block in parse(zlib.decompress(content.as_py(), 31)):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["warc-type"]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                else:
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                rows.append(
                    (
                        _page(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind,
                        _page(headers.get("warc-refers-to")), None if payload is None else payload.decode(),
                    )
                )
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below ``path``; see ``RECORD_SCHEMA``.

    A response's size and digest are taken anew from its payload; a revisit has none
    and gives those of its headers.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, RECORD_SCHEMA)


def op9_warc(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives below ``path`` (new in the shared folder) and read them back."""
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    write_archives(resolve_revisits(pages), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
