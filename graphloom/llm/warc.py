"""WARC/1.1 archives written and read as streams of chunks.

Writing: each task appends records, each a gzip member, to archive files of about
ARCHIVE_BYTES, compressing the payload chunk by chunk. A record is an HTTP response
(a head and the payload). Of equal payloads of at least 100 bytes the one with the
smallest id is written whole (response), the others as revisit records with the
profile of identical payload digests, an empty block and the id that they refer to.
The digest that finds equals is native: ids and digests are shuffled to find them, and
each payload once to meet its role; hot digests are split by skew joins. Ids of records are random UUIDs; the
key of the row and the one it refers to stand in extension fields.

Reading: a task streams an archive and yields a row per chunk of payload: record id,
chunk number, chunk bytes, bytes and SHA-256 digest so far. An oversized payload thus
is many rows and is never held whole by the reader. The row that ends a record
holds the digest of all of it; one that differs from the declared digest is an error.

Null payloads count as empty; empty ones are responses of no bytes (one chunk
row). Repeated rows give one record each; rows without an id are responses. Keys are
integers. An empty table gives no archive. Only the three named columns are read.
Archives carry a random part in their
names and only those that a finished task reports are read, so a retried task
leaves no second copy in the result.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut, fresh_path

CHUNK_BYTES = 1 << 18
ARCHIVE_BYTES = 16 << 20
#: Bytes of archives that a reading task gets.
TASK_BYTES = 64 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_SHARED = 100
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id long, record_type string, refers_to long, declared_digest string, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def with_roles(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, digest, size, refers_to): refers_to is the smallest key of an equal, large enough payload, or null for that one itself."""
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    each = pages.select(F.col(key).alias("record_id"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    first = each.filter(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return each.join(first, "digest", "left").select("record_id", "digest", "size", F.when(F.col("record_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def _head(key: int | None, refers: int | None, digest: str, url: str | None, size: int, date: str) -> bytes:
    """The head of a record and, of a response, that of its HTTP message."""
    http = b"" if refers is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = quote(url or f"urn:page:{'' if key is None else key}", safe="!#$%&'()*+,/:;=?@[]~")
    lines = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {refers}"] if refers is not None else []
    lines += [f"X-Key: {key}"] if key is not None else []
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size if refers is None else 0}", "", ""]).encode() + http


def write_archives(pages: DataFrame, key: str, url: str, payload: str, date: str | None = None) -> DataFrame:
    """Write every row as a WARC record of ``date`` (now, if not given); the result lists the archives written."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    roles = with_roles(pages, key, payload).filter(F.col("refers_to").isNotNull()).select("record_id", "digest", "refers_to").distinct()
    folder = fresh_path(pages.sparkSession, "warc")
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("record_id"), F.col(url).alias("url"), data.alias("payload"), F.sha2(data, 256).alias("digest"))
    rows = rows.join(roles, ["record_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        out, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            ids, urls, datas, digests, refers = (batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "url", "payload", "digest", "refers_to"))
            for i in range(batch.num_rows):
                if out is None:
                    files.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = files.open_output_stream(path, compression=None), 0, 0
                to = refers[i].as_py()
                body = datas[i].as_buffer() if to is None else pa.py_buffer(b"")
                head = _head(ids[i].as_py(), to, digests[i].as_py(), urls[i].as_py(), body.size, date)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member for each record
                size += out.write(packer.compress(head))
                for at in range(0, body.size, CHUNK_BYTES):
                    size += out.write(packer.compress(body.slice(at, min(CHUNK_BYTES, body.size - at))))
                size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                records += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_records(path: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of one archive, in file order."""
    files, name = place(path)
    with files.open_input_stream(name, compression=None, buffer_size=1 << 20) as packed, gzip.GzipFile(fileobj=packed, mode="rb") as f:
        left = b""

        def line() -> bytes:
            nonlocal left
            while (at := left.find(b"\r\n")) < 0:
                more = f.read(1 << 12)
                if not more:
                    raise ValueError(f"{path} ends inside a header")
                left += more
            got, left = left[:at], left[at + 2 :]
            return got

        def take(n: int) -> bytes:
            nonlocal left
            got, left = left[:n], left[n:]
            while len(got) < n:
                more = f.read(n - len(got))
                if not more:
                    raise ValueError(f"{path} ends inside a record")
                got += more
            return got

        while True:
            if not left:
                left = f.read(1 << 12)
                if not left:
                    return
            if line().decode() != VERSION:
                raise ValueError(f"{path}: a record does not begin with its version")
            head: dict[str, str] = {}
            while text := line():
                name_, _, value = text.decode().partition(":")
                head[name_.strip().lower()] = value.strip()
            size, http = int(head["content-length"]), 0
            if size and head["content-type"].startswith("application/http"):
                while text := line():
                    http += len(text) + 2
                http += 2
            size, digest, done, no = size - http, hashlib.sha256(), 0, 0
            key, refers = (int(head[k]) if k in head else None for k in ("x-key", "x-refers-to-key"))
            declared = head["warc-payload-digest"].partition(":")[2]
            while True:
                chunk = take(min(chunk_bytes, size - done))
                done += len(chunk)
                digest.update(chunk)
                if done == size and head["warc-type"] == "response" and digest.hexdigest() != declared:
                    raise ValueError(f"{path}: the payload of {head['warc-record-id']} does not have the declared digest")
                yield key, head["warc-type"], refers, declared, no, chunk, done, digest.hexdigest(), done == size
                no += 1
                if done == size:
                    break
            if take(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record does not end as it should")


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives listed in ``manifest``."""

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for paths in batches:
            for path in paths.column(paths.schema.get_field_index("path")).to_pylist():
                rows, held = [], 0
                for row in read_records(path):
                    rows.append(row)
                    held += len(row[5])
                    if held >= 4 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least = manifest.sparkSession.sparkContext.defaultParallelism * 2
    return manifest.repartition(max(1, min(files, max(least, math.ceil(size / TASK_BYTES)))), "path").mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its bytes, digest and type; a revisit takes bytes and digest from the response it names.

    The ends of the records are written first, so that the archives are read once and
    the join is planned by their true size.
    """
    ends = chunks.filter("last").select("record_id", "record_type", "refers_to", F.col("bytes_so_far").alias("own_bytes"), F.col("digest_so_far").alias("own_digest"), "declared_digest")
    ends = cut(ends, "record-ends")
    heads = ends.filter("record_type = 'response'").groupBy(F.col("record_id").alias("head_id"), F.col("own_digest").alias("head_digest")).agg(F.first("own_bytes").alias("head_bytes"))
    whole = ends.join(heads, (ends["refers_to"] == heads["head_id"]) & (ends["declared_digest"] == heads["head_digest"]), "left")
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "record_id",
        F.when(revisit, F.col("head_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("head_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
