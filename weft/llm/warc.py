"""WARC archives: a writer with revisit records, and a sequential reader.

Every record is one gzip member. The reader inflates member after member with zlib, a bounded piece
of the file at a time, frames the block by Content-Length and verifies both digests. Pages whose
payloads are equal and long enough share one response record; the others are revisit records that
hold the HTTP header alone, so their payload's length and digest come from header fields.

Defined cases: a null payload is empty. A null url becomes about:blank, and white space and control
characters in urls are percent-encoded. Null page ids come after all others when the response is
chosen, and stay null. Of rows that repeat id and payload, one is the response. An empty table gives
no archives. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import open_fs, scratch, tidy, write_file
from weft.llm.groups import attach

READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(row: str, run: str = "") -> str:
    """The same for a row whenever its task is repeated, another in any other run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{row}')}>"


def _safe_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "about:blank"


def record(page_id: int | None, row: str, url: str | None, payload: bytes, first: tuple[int | None, str] | None, run: str = "") -> bytes:
    """One compressed record; first: id and name of the page that holds the payload, if that's another; run: what record ids are unique to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {_record_id(row, run)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe_url(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first[1], run)}"] if first else []),
        *([f"X-Refers-To-Page: {first[0]}"] if first and first[0] is not None else []),
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one after another."""
    held, unzip, out = b"", None, []
    while True:
        if not held:
            held = stream.read(READ_BYTES)
            if not held:
                if unzip is not None:
                    raise ValueError("the archive ends within a record")
                return
        if unzip is None:
            unzip, out = zlib.decompressobj(31), []
        out.append(unzip.decompress(held))
        held = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            yield b"".join(out)
            unzip = None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record, framed and verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length isn't its Content-Length")
    block = rest[:n]
    if (d := fields.get("warc-block-digest")) and d != "sha1:" + digest32(block):
        raise ValueError("a block doesn't match its digest")
    return fields, block


def read_records(path: str) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of an archive's records."""
    fs, at = open_fs(path)
    with fs.open_input_stream(at, compression=None) as stream:
        for data in members(stream):
            fields, block = parse(data)
            http, _, payload = block.partition(b"\r\n\r\n")
            n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            if kind == "response" and (len(payload) != n or digest32(payload) != digest):
                raise ValueError("a payload doesn't match its digest")
            page, first = fields.get("x-page-id"), fields.get("x-refers-to-page")
            yield (int(page) if page else None, n, digest, kind, int(first) if first else None, fields["warc-target-uri"], payload if kind == "response" else None)


@tidy
def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    path, n = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz", [0]

    def records() -> Iterator[bytes]:
        for b in batches:
            for page, row, url, html, first, first_row in zip(*(b.column(c) for c in ("page_id", "row", "url", "html", "first_id", "first_row")), strict=True):
                n[0] += 1
                other = None if first_row.as_py() in (None, row.as_py()) else (first.as_py(), first_row.as_py())
                yield record(page.as_py(), row.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), other, folder)

    rest = records()
    head = next(rest, None)
    if head is None:
        return

    def again() -> Iterator[bytes]:
        yield head
        yield from rest

    size = write_file(path, again())
    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n[0]], "bytes": [size]})


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> list[str]:
    """Write a record for each page below a folder that executors share; the archives' paths."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    # a row is named by its content; only rows that repeat another wholly are told apart by a number
    rows = rows.withColumn("own", F.xxhash64("page_id", "url", "digest").cast("string")).withColumn("number", F.monotonically_increasing_id())
    same = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest", "page_id", "own").agg(F.count("*").alias("n"), F.min("number").alias("number"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "own", "n", "number"))
    groups = same.groupBy("digest").agg(first.alias("f"), F.sum("n").alias("copies")).where("copies > 1")
    numbered = lambda own, number: F.concat_ws("/", own, number)
    groups = groups.select(
        "digest", F.col("f.page_id").alias("first_id"), F.col("f.own").alias("first_own"), F.when(F.col("f.n") == 1, F.col("f.own")).otherwise(numbered(F.col("f.own"), F.col("f.number"))).alias("first_row"), "copies"
    )
    linked = attach(rows, groups, "digest", "copies", pages.count())
    alone = (F.col("own") == F.col("first_own")) & (F.col("first_own") == F.col("first_row"))
    linked = linked.select("page_id", F.when(alone, F.col("own")).otherwise(numbered(F.col("own"), F.col("number"))).alias("row"), "url", "html", "first_id", "first_row")
    files = linked.mapInArrow(partial(_write, folder=folder), "path string, records long, bytes long").collect()
    return sorted(f.path for f in files)


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@tidy
def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] if payloads else [])]
    for b in batches:
        for path in b.column(0).to_pylist():
            held: list[tuple] = []
            size = 0
            for r in read_records(path):
                held.append(r[: len(names)])
                size += r[1] if payloads else 0
                if len(held) == 5000 or size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, paths: list[str], payloads: bool = False) -> DataFrame:
    """A row for each record; with payloads also url and payload (null in revisits). One archive is one task's."""
    kind = COLUMNS + (", url string, payload binary" if payloads else "")
    if not paths:
        return spark.createDataFrame([], kind)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return listed.mapInArrow(partial(_read, payloads=payloads), kind)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, scratch(spark, "warc")))
