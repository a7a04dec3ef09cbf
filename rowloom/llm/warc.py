"""WARC archives: write the captures of pages, read records back, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload captured before) and a metadata
record; request and metadata name the response's record in WARC-Concurrent-To. Archives are
written by Spark's text writer, a record to a row, and read whole file by whole file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.session import fresh_path, settle

#: payloads from this size on may be revisits
LEAST_REVISIT = 100
#: records of one archive file
FILE_RECORDS = 3_000
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def _record_id(kind: str, identity: Column) -> Column:
    """A record id that follows from what it identifies."""
    h = F.md5(F.concat(F.lit(kind + "|"), identity))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A WARC record without its closing line ends; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def write(pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write three records for each of ``pages`` below ``path``.

    Of equal payloads of at least ``least`` bytes the one with the smallest id is the response and the others
    revisit it; rows that share that id are all responses, and a null id is larger than any other. A null payload is empty.
    Line ends in a url are percent-encoded; without a url the records have no target.
    """
    payload = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("string").alias("id"), F.col(id_column).alias("order"), F.col(url_column).alias("url"), payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"),
    )
    identity = lambda page, digest: F.concat(F.coalesce(page, F.lit("-")), F.lit("|"), digest)
    # written first, so that the join has plain shuffles on both sides and a hot digest can be split
    first = settle(rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("order").cast("string").alias("first")), "warc-first")
    held = rows.join(first, "digest", "left").withColumn("me", identity(F.col("id"), F.col("digest")))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    host = F.coalesce(F.regexp_extract(uri, r"^[a-zA-Z]+://([^/?#\s]+)", 1), F.lit(""))
    target = ("WARC-Target-URI", uri)
    response_id = _record_id("response", F.col("me"))
    http_request = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    http_head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = lambda what: ("Content-Type", F.lit(f"application/http; msgtype={what}"))
    answer = F.when(
        revisit,
        _record("revisit", [
            ("WARC-Record-ID", response_id), target, digest, http("response"),
            ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", _record_id("response", identity(F.col("first"), F.col("digest")))),
        ], http_head),
    ).otherwise(_record("response", [("WARC-Record-ID", response_id), target, digest, http("response")], F.concat(http_head, F.col("payload"))))
    request = _record(
        "request", [("WARC-Record-ID", _record_id("request", F.col("me"))), target, ("WARC-Concurrent-To", response_id), http("request")], http_request
    )
    fields = F.concat(F.lit("page-id: "), F.coalesce("id", F.lit("")), F.lit("\r\npayload-bytes: "), F.col("n").cast("string"), F.lit(_CRLF))
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _record_id("metadata", F.col("me"))), target, ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    records = held.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    records.write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>"
)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and name:
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _rows(content: bytes, with_payload: bool) -> Iterator[tuple]:
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    for headers, block in parse(stream):
        kind = headers.get("warc-type")
        payload, fields, n = None, [], None
        digest = headers.get("warc-payload-digest")
        digest = digest.partition(":")[2] if digest else None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            n = len(payload)
            if digest and digest != hashlib.sha256(payload).hexdigest():
                raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
        elif kind == "metadata":
            pairs = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
            fields = [(k.strip(), v.strip()) for k, _, v in pairs]
        yield (
            headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-concurrent-to"),
            headers.get("warc-refers-to"), digest, n, payload if with_payload else None, fields,
        )


def _reader(with_payload: bool):
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [part.split()[0] for part in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column("content"):
                rows: list[tuple] = []
                held = 0
                for row in _rows(content.as_py(), with_payload):
                    rows.append(row)
                    held += len(row[8] or b"")
                    if len(rows) >= 1_000 or held >= 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path``, gzip or plain, with the columns of RECORD.

    Payload and payload_bytes are those of responses; a payload that does not have its record's digest raises.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # a row is a whole file
    spark.conf.set(name, "4")
    try:
        return settle(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_reader(with_payload), RECORD), "warc-records")
    finally:
        spark.conf.set(name, before)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (record_id, target_uri, record_type, payload_digest, payload_bytes, refers_to, response, request, metadata).

    Requests and metadata join the response or revisit that they are concurrent to; either may be missing. Records that
    repeat an id pair off one by one. A revisit's payload_bytes are those of the response it refers to, null if that is not there.
    """
    def numbered(kind: str, key: str) -> DataFrame:
        part = records.where(F.col("type") == kind).where(F.col(key).isNotNull())
        copy = F.row_number().over(W.partitionBy(key).orderBy("record_id", "target_uri"))
        return part.select(F.col(key).alias("_key"), copy.alias("_copy"), F.struct("record_id", "target_uri", "date", "fields").alias(kind))

    answers = records.where(F.col("type").isin("response", "revisit")).withColumn(
        "_copy", F.row_number().over(W.partitionBy("record_id").orderBy("target_uri"))
    )
    out = answers.select(
        F.col("record_id").alias("_key"), "_copy", "record_id", "target_uri", F.col("type").alias("record_type"), "payload_digest", "payload_bytes",
        "refers_to", F.struct("record_id", "date", "payload").alias("response"),
    )
    for kind in ("request", "metadata"):
        out = out.join(numbered(kind, "concurrent_to"), ["_key", "_copy"], "left")
    originals = settle(
        answers.where("type = 'response' and _copy = 1").select(F.col("record_id").alias("_original"), F.col("payload_bytes").alias("_bytes")), "originals"
    )
    # a response meets itself, so that rows without a reference do not gather in one task
    out = out.join(originals, F.coalesce("refers_to", "record_id") == F.col("_original"), "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_key", "_copy", "_original", "_bytes")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back: one digest row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    captures = assemble(read(spark, path, with_payload=False))
    page = F.nullif(F.col("metadata.fields")["page-id"], F.lit("")).cast(pages.schema["page_id"].dataType)
    found = settle(captures.select(page.alias("page_id"), "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "captures")
    named = found.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page")).dropDuplicates(["_id"])
    named = settle(named, "named")
    return found.join(named, F.coalesce("refers_to", "record_id") == F.col("_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), F.col("_page")).alias("refers_to")
    )
