"""WARC archives with revisit records.

Records are written as WARC 1.1 by Spark's text writer with CR LF CR LF as the line separator, which is
just what ends a WARC record, so archives go to any file system that Spark writes and appear only when
the job commits. Archives are read as a stream: Spark's text reader cuts them at the same separator, and the
pieces are put together again by each record's Content-Length, so no text inside a payload can be taken for a
header, and a task holds one record and a batch, however large the archive. Files have ARCHIVE_RECORDS records
at most; gzip files of one or of many members are read.

Revisit resolution works on headers: of those read back from an archive, payload digests are counted
and their smallest page id found (partial aggregates first, so a payload that a third of all pages has
is no hot key), and records are joined to the originals by digest. Revisits that the archive has
already are resolved in the same way, by the digest they carry. A second set of archives is written with
fresh headers: a response keeps its payload, a revisit has the header of its original and no payload.

Payloads of less than MIN_PAYLOAD bytes are always responses. Defined results: a null html is an empty
payload; rows with a null page_id keep it and sort behind all others as originals; repeated rows with
one page_id give a record each, of which all are responses if the id is the smallest; a URL with line ends is
percent-encoded (as is its %) in its header, beside a field that says so, and any other stands as it is; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import NULL_ID, small_batches, work_path, written

MIN_PAYLOAD = 100
#: Records of an archive file at most.
ARCHIVE_RECORDS = 2000
SEPARATOR = "\r\n\r\n"

#: What is escaped in a URL with line ends, in order.
_CODES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, type string, uri string, digest string, payload_bytes long, refers_to long, payload string"


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; those whose value is null are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields))


def _odd(uri: Column) -> Column:
    return uri.rlike("[\r\n]")


def _uri(uri: Column) -> Column:
    escaped = uri
    for sign, code in _CODES:
        escaped = F.replace(escaped, F.lit(sign), F.lit(code))
    return F.when(_odd(uri), escaped).otherwise(uri)


def _uri_of(head: dict[bytes, bytes]) -> str | None:
    uri = head.get(b"warc-target-uri")
    if uri is not None and b"uri-encoding" in head:
        for sign, code in reversed(_CODES):
            uri = uri.replace(code.encode(), sign.encode())
    return None if uri is None else uri.decode("utf-8", "replace")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(records: DataFrame, path: str) -> None:
    """Records (page_id, type, uri, digest, payload_bytes, refers_to, payload) as WARC files under path."""
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes"))), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    head = _lines(
        ("WARC-Type", F.col("type")),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Target-URI", _uri(F.col("uri"))),
        ("URI-Encoding", F.when(_odd(F.col("uri")), "percent")),
        ("WARC-Date", F.lit(_DATE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, _PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length(F.coalesce("payload", F.lit(""))))),
    )
    text = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block)
    records.select(text.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


_FIELD = re.compile(rb"([^:\r\n]+): ([^\r\n]*)\r\n")


def _number(urn: bytes) -> int | None:
    return None if b"none" in urn else int(urn.rpartition(b":")[2].rstrip(b">"))


def take_record(data: bytes | bytearray, at: int) -> tuple[tuple | None, int] | None:
    """The record at a place of an uncompressed archive, as RECORD, and where it ends; None instead of the record
    if it is of another type, and None at all if the data end before it does."""
    end = data.find(b"\r\n\r\n", at) + 4
    if end < 4:
        return None
    if not data.startswith(b"WARC/1.", at):
        raise ValueError(f"no record at byte {at}")
    head = {k.lower(): v for k, v in _FIELD.findall(data, data.index(b"\r\n", at) + 2, end)}
    stop = end + int(head[b"content-length"])
    if stop > len(data):
        return None
    if head[b"warc-type"] not in (b"response", b"revisit"):
        return None, stop
    http, _, payload = bytes(data[end:stop]).partition(b"\r\n\r\n")
    own = {k.lower(): v for k, v in _FIELD.findall(http + b"\r\n")}
    kind, refers = head[b"warc-type"].decode(), head.get(b"warc-refers-to")
    digest = head.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode()
    length = int(own.get(b"content-length", len(payload)))
    if kind == "response" and (digest != hashlib.sha256(payload).hexdigest() or length != len(payload)):
        raise ValueError(f"record {head.get(b'warc-record-id')} isn't what its header says")
    return (_number(head[b"warc-record-id"]), kind, _uri_of(head), digest, length, refers and _number(refers), payload if kind == "response" else None), stop


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records from the pieces between separators, file after file, in order."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    data = bytearray()
    for batch in batches:
        rows, at = [], 0
        for piece in batch.column("value").cast(pa.binary()).to_pylist():
            data += piece + SEPARATOR.encode()
            while True:
                while data[at : at + 1] in (b"\r", b"\n"):  # what ends a record
                    at += 1
                found = take_record(data, at) if at < len(data) else None
                if not found:  # the rest of the record is in the next pieces
                    break
                record, at = found
                if record:
                    rows.append(record if payloads else (*record[:-1], None))
        del data[:at]
        if rows:
            yield _batch(rows, kinds, names)
    if data:
        raise ValueError("an archive ends inside a record")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    columns[-1] = columns[-1].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path; without payloads, their headers only."""
    small_batches(spark)
    files = spark.read.option("recursiveFileLookup", "true").option("lineSep", SEPARATOR).text(path).select("value")
    return files.mapInArrow(lambda it: _records(it, payloads), RECORD)


def page_records(pages: DataFrame) -> DataFrame:
    """A response record for each page."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.lit("response").alias("type"),
        F.col("url").alias("uri"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.lit(None).cast("long").alias("refers_to"),
        payload.alias("payload"),
    )


def resolve_revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, digest and the original's page_id for each record that becomes a revisit: of the records
    with one digest, all but that with the smallest page_id. Revisits of an archive are resolved anew."""
    key = F.coalesce("page_id", F.lit(NULL_ID))
    long_ones = headers.filter(F.col("payload_bytes") >= min_payload)
    groups = long_ones.groupBy("digest").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first < last").select("digest", "first")
    # a table of its own, so that the join has an exchange on both sides and a hot digest can be split
    groups = written(groups, "originals")
    return long_ones.select(key.alias("_key"), "digest").join(groups, "digest").filter(F.col("_key") != F.col("first")).select("_key", F.col("digest").alias("_digest"), "first").distinct()


def deduplicate(spark: SparkSession, source: str, target: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Read archives, resolve revisits by their headers, and write archives with fresh headers."""
    headers = written(read_archives(spark, source, payloads=False).select("page_id", "digest", "payload_bytes"), "headers")
    revisits = written(resolve_revisits(headers, min_payload), "revisits")
    records = read_archives(spark, source)
    joined = records.join(revisits, (F.coalesce("page_id", F.lit(NULL_ID)) == F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    fresh = F.col("first").isNotNull()
    out = joined.select(
        "page_id",
        F.when(fresh, "revisit").otherwise("response").alias("type"),
        "uri",
        "digest",
        "payload_bytes",
        F.col("first").alias("refers_to"),
        F.when(~fresh, F.col("payload")).alias("payload"),
    )
    write_archives(out, target)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, deduplicate these, and give the headers of the result."""
    spark = pages.sparkSession
    raw, clean = work_path(spark, "warc"), work_path(spark, "warc-deduplicated")
    write_archives(page_records(pages), raw)
    deduplicate(spark, raw, clean)
    return read_archives(spark, clean, payloads=False)


def archive_digest(pages: DataFrame) -> DataFrame:
    out = archive_pages(pages.select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
