"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

A page gives three records: a response (or a revisit, where an equal payload is already archived), a
request and a metadata record; the last two name the first in WARC-Concurrent-To. Every record is a gzip
member of its own, so a reader may start at any record; the manifest lists such places.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.shared import filesystem, spread, stored

#: Smaller payloads are always archived in full.
LEAST = 100
#: Bytes of an archive file, and of the part of it that a task reads.
FILE = 1 << 30
PART = 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, start bigint, size bigint, records bigint"
RECORDS = (
    "record_id string, record_type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, http_headers string, payload binary, fields map<string,string>"
)


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A compressed record; line ends in header values are percent-encoded."""
    head = "".join(f"{k}: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in headers if v is not None)
    code = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return code.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + code.flush()


def capture(page_id: int | None, url: str | None, html: str | None, digest: str, first: dict | None) -> Iterator[bytes]:
    """The records of one page; ``first`` (page_id, url) is the capture whose payload a revisit refers to."""
    payload, own = (html or "").encode(), record_id("capture", page_id, url, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url or "")]
    headers = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("capture", first["page_id"], first["url"], digest))]
    yield record(headers, http if first else http + payload)
    try:
        where = urlsplit(url or "")
        host, target = where.netloc, (where.path or "/") + (f"?{where.query}" if where.query else "")
    except ValueError:
        host, target = "", url or ""
    block = re.sub("[\r\n]", " ", f"GET {target} HTTP/1.1") + "\r\n" + re.sub("[\r\n]", " ", f"Host: {host}") + "\r\n\r\n"
    yield record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], block.encode())
    fields = {"page-id": page_id, "refers-to-page-id": first and first["page_id"]}
    block = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    yield record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], block.encode())


def write(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``path``; returns the manifest.

    Of payloads that are equal and have ``least`` bytes or more, the smallest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses as well, and rows without a page_id
    revisit where a row with one exists. A null html is an empty payload, a null url an empty one.
    Other columns are not archived. An empty table gives no record. Pages are not shuffled unless the
    repeated payloads are too many to broadcast, and then skewed ones are split. A repeated
    attempt of a task writes to another file, and only files in the manifest count.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    copies = pages.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("n")).where("n > 1")
    firsts = large.groupBy(F.col("digest").alias("of")).agg(F.min(F.struct("page_id", "url")).alias("first"))
    firsts = stored(firsts.join(copies, "of", "left_semi"), "firsts")
    rows = pages.join(firsts, F.col("digest") == F.col("of"), "left")
    rows = rows.withColumn("first", F.when(F.coalesce(F.col("page_id") > F.col("first.page_id"), F.col("first").isNotNull()), F.col("first")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        sink, parts = None, []
        for batch in batches:
            for page in zip(*(c for c in batch.columns)):
                for data in capture(*(x.as_py() for x in page)):
                    if sink is None:
                        name, at = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        parts.append([name, 0, 0, 0])
                    if parts[-1][2] >= PART:
                        parts.append([name, at, 0, 0])
                    sink.write(data)
                    at += len(data)
                    parts[-1][2] += len(data)
                    parts[-1][3] += 1
                if at >= FILE:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "start", "size", "records"])

    rows.select("page_id", "url", "html", "digest", "first").mapInArrow(task, MANIFEST).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def parse(data: bytes) -> dict:
    """One uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    kind, out = headers.get("content-type", ""), {"http_headers": None, "payload": None, "fields": None}
    if kind.startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out |= {"http_headers": http.decode(), "payload": payload}
    elif kind.startswith("application/warc-fields"):
        out["fields"] = [(k, v) for k, _, v in (line.partition(": ") for line in block.decode().split("\r\n") if line)]
    return out | {
        "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "payload_digest": headers.get("warc-payload-digest"),
    }


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed gzip members of ``data``."""
    view, at = memoryview(data), 0
    while at < len(view):
        code, out = zlib.decompressobj(31), []
        while not code.eof:
            fed = view[at : at + step]
            if not len(fed):
                raise ValueError("a record is cut off")
            out.append(code.decompress(fed))
            at += len(fed) - len(code.unused_data)
        yield b"".join(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, a task for some parts of the files."""
    schema = pa.schema([*((n, pa.string()) for n in "record_id record_type target_uri date concurrent_to refers_to payload_digest http_headers".split()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{folder}/{name}") as source:
                    data = source.read_at(size, start)
                rows, held = [], 0
                for member in members(data):
                    rows.append(parse(member))
                    held += len(member)
                    if held > PART:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "start", "size")
    return spread(parts, "size", "file", "start").mapInArrow(task, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, response, request, metadata.

    A response or revisit is a capture, and requests and metadata records join it by the identifier they are
    concurrent to. Of several requests, or metadata records, of a capture the one with the smallest record id counts. Records
    that are concurrent to no capture give a row without a response; those that name none are left out.
    A capture that is archived twice gives two rows. Records are read and shuffled once.
    """
    main, request, metadata = (F.col("record_type").isin(*kinds) for kinds in (("response", "revisit"), ("request",), ("metadata",)))
    side = (request | metadata) & F.col("concurrent_to").isNotNull()
    rows = records.where(main | side).withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    of = Window.partitionBy("capture_id")

    def first(kind: F.Column, *columns: str) -> F.Column:
        return F.min(F.when(kind, F.struct("record_id", *columns))).over(of)

    rows = rows.select(
        "capture_id", "target_uri", main.alias("main"), F.when(main, F.struct("record_type", "date", "refers_to", "payload_digest", "http_headers", "payload")).alias("response"),
        first(request, "date", "http_headers").alias("request"),
        # a map has no order: the fields are compared, and carried, as entries
        F.min(F.when(metadata, F.struct("record_id", "date", F.map_entries("fields").alias("fields")))).over(of).alias("metadata"),
        F.min(F.when(side, F.col("target_uri"))).over(of).alias("uri"),
        F.max(main).over(of).alias("known"), F.row_number().over(of.orderBy("record_id")).alias("place"),
    )
    metadata = F.when(F.col("metadata").isNotNull(), F.struct("metadata.record_id", "metadata.date", F.map_from_entries("metadata.fields").alias("fields")))
    return rows.where("main OR NOT known AND place = 1").select("capture_id", F.coalesce(F.when(F.col("main"), F.col("target_uri")), "uri").alias("target_uri"), "response", "request", metadata.alias("metadata"))
