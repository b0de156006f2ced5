"""WARC archives: written by record, read sequentially (operator 6).

Each record is a gzip member of its own. The reader decompresses a file
incrementally, frames records by Content-Length and checks payload digests.

Archives go to a folder that all executors share, through pyarrow's file
systems (local or mounted paths, hdfs, s3, gs). A task writes files under
names of its own and reports them as rows; only reported files are read, so
a retried or speculative task leaves at most an unread file behind.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import in_slices, shared_path, staged, utf8
from keepwise.operators.joins import fresh

DATE = "2024-01-01T00:00:00Z"  # of every record: archives of the same rows are the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def open_folder(uri: str):
    """(file system, path) of a folder given as a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id_of(value: str) -> str | None:
    value = value[len("<urn:page:"):-1]
    return None if value == "none" else value


def make_record(page_id, url: str | None, payload: bytes, refers_to=None, level: int = 3) -> bytes:
    """One record as a gzip member; with ``refers_to``, a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + 2 * _CRLF + block + 2 * _CRLF
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    raw, z, out = stream.read(step), None, []
    while raw:
        if z is None:
            z, out = zlib.decompressobj(31), []
        out.append(z.decompress(raw))
        raw = z.unused_data if z.eof else b""
        if z.eof:
            yield b"".join(out)
            z = None
        raw = raw or stream.read(step)
    if z is not None:
        raise ValueError("the archive ends within a record")


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(headers, full payload length, payload; of a revisit, empty) of one member's content."""
    head, mark, rest = raw.partition(2 * _CRLF)
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(head)
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != 2 * _CRLF:
        raise ValueError("the record's length differs from its Content-Length")
    http, mark, payload = rest[:size].partition(2 * _CRLF)
    if not mark:
        raise ValueError("the record has no HTTP headers")
    full = int(_headers(http)["content-length"])
    if headers["warc-type"] == "response":
        if len(payload) != full:
            raise ValueError("the payload's length differs from its headers")
        if b32encode(hashlib.sha1(payload).digest()).decode() != headers["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't match its digest")
    return headers, full, payload


def with_heads(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 1000) -> DataFrame:
    """``pages`` with ``refers_to``: the largest id of an equal payload, if it is another row's.

    Payloads under ``least`` bytes refer to none and meet under keys made of
    their own ids. Digests meet by hash with partial maxima, so a payload on a
    third of all rows is a row per task.
    """
    key, head, n = (fresh(x, pages.columns) for x in ("__digest", "__head", "__n"))
    body = F.coalesce(utf8(html), F.lit("").cast("binary"))
    digest, size = F.sha1(body), F.octet_length(body)
    heads = staged(
        pages.where(size >= least).groupBy(digest.alias(key)).agg(F.max(page_id).alias(head), F.count(F.lit(1)).alias(n))
        .where(F.col(n) > 1).select(key, head), "heads")
    alone = F.concat(F.lit("alone "), F.xxhash64(F.col(page_id), size).cast("string"))  # no digest, and not one key for all
    other = ~F.col(page_id).eqNullSafe(F.col(head))
    return (pages.withColumn(key, F.when(size >= least, digest).otherwise(alone)).join(heads, key, "left")
            .withColumn("refers_to", F.when(other, F.col(head))).drop(key, head))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record per row of ``pages`` (with ``refers_to``); the manifest of the archives.

    Null html is empty, null ids and urls are left out of the headers. The
    manifest is staged, so the archives are written once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        stream, path, records, size, done = None, None, 0, 0, []
        for batch in batches:
            for part in in_slices(batch, "html", 8 << 20):
                ids, urls, heads = (part.column(c).to_pylist() for c in ("id", "url", "refers_to"))
                for one, link, head, body in zip(ids, urls, heads, part.column("html")):
                    if stream is None:
                        path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        stream = files.open_output_stream(path, compression=None)
                    raw = make_record(one, link, body.as_buffer().to_pybytes() if body.is_valid else b"", head)
                    stream.write(raw)
                    records, size = records + 1, size + len(raw)
                    if size >= file_bytes:
                        stream.close()
                        stream = None
                        done.append((path, records, size))
        if stream is not None:
            stream.close()
            done.append((path, records, size))
        if done:
            paths, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(url).cast("string").alias("url"),
                        F.col("refers_to").cast("string").alias("refers_to"), utf8(html).alias("html"))
    return staged(rows.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest``, a file at a time per task.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest (both
    of the full payload) and, ``with_payload``, the payload (null: a revisit).
    Damaged archives raise.
    """
    schema = RECORD + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        files, _ = open_folder(folder)
        names = [f.split()[0] for f in schema.split(", ")]

        def out(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, columns)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        headers, full, payload = parse_record(raw)
                        refers, link = headers.get("warc-refers-to"), headers.get("warc-target-uri")
                        response = headers["warc-type"] == "response"
                        digest = b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((_id_of(headers["warc-record-id"]), unquote(link) if link is not None else None, headers["warc-type"],
                                     _id_of(refers) if refers else None, full, digest, *([payload if response else None] * with_payload)))
                        held += len(payload) * with_payload
                        if len(rows) >= 10_000 or held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    few = manifest.select("path").repartition(max(1, manifest.count()))
    return few.mapInArrow(run, schema)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, with_payload: bool = False) -> DataFrame:
    """Archives of ``pages`` written to the shared folder and read back.

    Of equal payloads of ``least`` bytes or more, the row with the largest id
    is the response (each of them, if several rows have it); the others revisit
    it. Ids keep their type.
    """
    folder = shared_path(pages.sparkSession, "warc")
    kind = pages.schema[page_id].dataType
    manifest = write(with_heads(pages, page_id, html, least), folder, page_id, url, html)
    out = read(manifest, folder, with_payload)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
