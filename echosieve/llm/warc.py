"""WARC archives without repeated payloads: revisits are resolved to their originals."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, written

#: Bytes of compressed records after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a payload that are compressed or read at once.
CHUNK = 1 << 20
#: Fixed value: the profile of a revisit that names an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records that are given none.
DATE = "1970-01-01T00:00:00Z"
#: Read tasks at most; beyond, a task reads several archives one after the other.
MOST_TASKS = 100_000

_INDEX = "path string, records long, bytes long"
_RECORD = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to_id string, payload string"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder and the path in it."""
    if not urlsplit(path).scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """A record's name: equal for equal pages, so that a task that runs again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _address(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&()*+,;=%~")


def _framed(head: list[str], block: bytes) -> bytes:
    block_digest = f"WARC-Block-Digest: sha1:{payload_digest(block)}"
    return "\r\n".join([*head, block_digest, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    fields = b"software: echosieve\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{name}')}>", f"WARC-Date: {date}"]
    return _framed([*head, f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], fields)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One record with fresh headers; its block is an HTTP message, of which a revisit has the head alone."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_address(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers, digest)}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_address(refers_url)}")
    return _framed(head, _http_head(len(payload)) + (b"" if revisit else payload))


def _member(data: bytes) -> bytes:
    """A gzip member of its own for each record, as readers that seek expect."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def headers(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, size and SHA-1 (hexadecimal) of each payload; a null page is empty."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("sha1"))


def resolve(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The original of each payload of at least ``least_bytes`` bytes that several records have."""
    # A null page_id sorts below all others, so it is the original only where all are null.
    groups = found.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("times"))
    return groups.where("times > 1").select("sha1", F.col("last.page_id").alias("original"), F.col("last.url").alias("original_url"))


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as compressed archives below ``out``; return their index.

    Headers alone are shuffled by digest; the originals found join the pages again. A task writes
    archives under names of its own and the index lists those of tasks that succeeded, so what a lost
    executor or a second attempt leaves behind is never read. All records carry one ``date``, the moment of
    the call if none is given.
    """
    moment = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    originals = written(resolve(headers(pages), least_bytes), "originals").select(F.col("sha1").alias("key"), "original", "original_url")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    rows = rows.join(originals, rows.sha1 == originals.key, "left").select("page_id", "url", "html", "original", "original_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(out)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        sink, path, count, size, number = None, "", 0, 0, 0
        done = []
        for b in batches:
            for page_id, url, text, original, original_url in zip(*(b.column(c) for c in ("page_id", "url", "html", "original", "original_url")), strict=True):
                payload = text.as_py().encode()
                own, first = page_id.as_py(), original.as_py()
                revisit = first is not None and own != first
                data = _member(record(own, url.as_py(), payload, payload_digest(payload), first, revisit, original_url.as_py(), moment))
                if sink is None:
                    path, count, size = f"{root}/{name}-{number:04d}.warc.gz", 0, 0
                    sink, number = system.open_output_stream(path, compression=None), number + 1
                    sink.write(_member(info(path.rpartition("/")[2], moment)))
                sink.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    done.append((path, count, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, count, size))
        scheme = out[: len(out) - len(root)] if out.endswith(root) else ""
        yield pa.RecordBatch.from_pylist([{"path": scheme + p, "records": n, "bytes": s} for p, n, s in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(rows.mapInArrow(run, _INDEX), "index")


def _members(stream: io.RawIOBase) -> Iterator[bytes]:
    """Decompressed gzip members of an archive, one after the other."""
    unpacker, parts, ahead = zlib.decompressobj(31), [], b""
    while True:
        data = ahead or stream.read(CHUNK)
        if not data:
            if parts:
                raise EOFError("an archive ends inside a record")
            return
        parts.append(unpacker.decompress(data))
        ahead = b""
        if unpacker.eof:
            yield b"".join(parts)
            ahead, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []


def parse(data: bytes) -> dict | None:
    """The fields of one record, None of an archive's own; a response's payload is checked against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    kind = fields["warc-type"]
    if kind == "warcinfo":
        return None
    message, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in message.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return {
        "record_id": fields["warc-record-id"],
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "url": fields.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to_id": fields.get("warc-refers-to"),
        "payload": payload.decode() if kind == "response" else None,
    }


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read every record of the archives that ``index`` lists, in a stream, an archive a row of it."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(_RECORD)
    if not with_payload:
        schema = StructType(schema.fields[:-1])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n in ("page_id", "payload_bytes") else pa.string() for n in names]
        arrow = pa.schema(list(zip(names, types, strict=True)))
        for b in batches:
            for path in b.column("path").to_pylist():
                system, at = filesystem(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for data in _members(stream):
                        if (found := parse(data)) is None:
                            continue
                        rows.append({n: found[n] for n in names})
                        size += len(data)
                        if size > 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return index.select("path").repartition(max(1, min(index.count(), MOST_TASKS))).mapInArrow(run, schema)


def archived(pages: DataFrame, least_bytes: int = 0, out: str | None = None) -> DataFrame:
    """Write pages as deduplicated archives, read those back and resolve revisits to their originals.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are ignored. Returns a row per row:
    ``page_id``, ``payload_bytes`` and ``payload_digest`` of the full payload, ``record_type`` and
    ``refers_to`` (the original's page_id). Null and empty pages have an empty payload. Of equal payloads
    of at least ``least_bytes`` bytes the record with the largest page_id is the response; rows that
    repeat that page_id too are responses each. Null page_ids revisit the others, or are responses where
    all are null; a null url is left out of the record. No pages, no archives, no rows.
    """
    index = write_archives(pages, out or new_path(pages.sparkSession, "warc"), least_bytes)
    records = read_archives(index, with_payload=False)
    kept = written(records, "records")
    named = kept.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("digest"), F.col("record_id").alias("id")).agg(F.max("page_id").alias("refers_to"))
    named = written(named.join(kept.where("refers_to_id is not null").select(F.col("payload_digest").alias("digest"), F.col("refers_to_id").alias("id")).distinct(), ["digest", "id"]), "referred")
    joined = kept.join(named, (kept.payload_digest == named.digest) & (kept.refers_to_id == named.id), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
