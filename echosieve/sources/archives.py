"""Members of zip and tar archives, listed and read where the archive's bytes are."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import IMAGE_EXTENSIONS
from ..functions.paths import natural_key
from ..operators.tables import stored

_MEMBER = "archive string, inner string, length bigint, content binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("inner", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Bytes of members in a batch.
BATCH_BYTES = 16 << 20


def members(content: bytes, with_content: bool) -> Iterator[tuple[str, int, bytes | None]]:
    """Picture members of an archive in order of names; the format is told by the content."""
    wanted = lambda name: name.rpartition(".")[2].lower() in IMAGE_EXTENSIONS
    stream = io.BytesIO(content)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as archive:
            for info in sorted(archive.infolist(), key=lambda i: i.filename):
                if not info.is_dir() and wanted(info.filename):
                    yield info.filename, info.file_size, archive.read(info) if with_content else None
        return
    stream.seek(0)
    with tarfile.open(fileobj=stream) as archive:
        for info in sorted(archive.getmembers(), key=lambda i: i.name):
            if info.isfile() and wanted(info.name):
                yield info.name, info.size, archive.extractfile(info).read() if with_content else None


def read(spark: SparkSession, root: str, pattern: str = "*.{zip,cbz,tar,cbt,tgz,gz,bz2}", with_content: bool = False) -> DataFrame:
    """Members of all archives below ``root``, a row each; an archive that can't be read has one with its error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    for inner, length, data in members(content.as_py(), with_content):
                        rows.append({"archive": path, "inner": inner, "length": length, "content": data, "error": None})
                        size += len(data or b"")
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, size = [], 0
                except (OSError, ValueError, EOFError, RuntimeError, NotImplementedError, tarfile.TarError, zipfile.BadZipFile) as x:
                    rows.append({"archive": path, "inner": None, "length": None, "content": None, "error": f"{type(x).__name__}: {x}"})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    out = found.select(F.regexp_replace("path", "^file:/{1,3}", "/").alias("path"), "content").mapInArrow(run, _MEMBER)
    return out.withColumn("path", F.concat(F.lit("zip://"), "archive", F.lit("!"), "inner"))


def trim_files(plan: DataFrame, dry: bool = False) -> DataFrame:
    """Write archives anew without the members that ``plan(archive, inner)`` drops: (archive, dropped, kept, error).

    The archive as it was stays beside the new one as ``.bak``, put there first and whole; an archive that can't be
    read or written stays as it is and gives a row with its error. With ``dry`` nothing is written.
    """
    asked = plan.groupBy("archive").agg(F.collect_set("inner").alias("drop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, drop in zip(b.column("archive").to_pylist(), b.column("drop").to_pylist(), strict=True):
                system, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                try:
                    with system.open_input_stream(at, compression=None) as file:
                        content = file.read()
                    names = {n for n, _, _ in members(content, False)}
                    gone = names & set(drop)
                    if gone and not dry:
                        fresh = trimmed(content, gone)
                        for name, data in ((f"{at}.bak", content), (f"{at}.new", fresh)):
                            with system.open_output_stream(name, compression=None) as file:
                                file.write(data)
                        system.move(f"{at}.new", at)
                    rows.append((path, len(gone), len(names) - len(gone), None))
                except (OSError, ValueError, EOFError, RuntimeError, NotImplementedError, tarfile.TarError, zipfile.BadZipFile) as x:
                    rows.append((path, 0, None, f"{type(x).__name__}: {x}"))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["archive", "dropped", "kept", "error"])

    return stored(asked.mapInArrow(run, "archive string, dropped bigint, kept bigint, error string"))


def unpacked(rows: DataFrame, out: str) -> DataFrame:
    """Write the members of ``rows(path, inner, content)`` as files below ``out``; (path, file) of each.

    A file's name follows from its path, so a second attempt writes the same again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (pafs.LocalFileSystem(), out)
        system.create_dir(root, recursive=True)
        for b in batches:
            names = []
            for path, inner, content in zip(*(b.column(c) for c in ("path", "inner", "content")), strict=True):
                names.append(f"{hashlib.sha1(path.as_py().encode()).hexdigest()}.{inner.as_py().rpartition('.')[2].lower()}")
                with system.open_output_stream(f"{root}/{names[-1]}", compression=None) as file:
                    file.write(content.as_py())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(names, pa.string())], ["path", "file"])

    return rows.where("content is not null").select("path", "inner", "content").mapInArrow(run, "path string, file string")


def last_members(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` members of each archive in natural order."""
    order = Window.partitionBy("archive").orderBy(natural_key(F.col("inner")).desc(), F.desc("inner"))
    return rows.where("inner is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def trimmed(content: bytes, drop: set[str]) -> bytes:
    """An archive written anew as a zip without the dropped members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        stream = io.BytesIO(content)
        if zipfile.is_zipfile(stream):
            with zipfile.ZipFile(stream) as archive:
                for info in archive.infolist():
                    if info.filename not in drop and not info.is_dir():
                        target.writestr(info.filename, archive.read(info))
        else:
            stream.seek(0)
            with tarfile.open(fileobj=stream) as archive:
                for info in archive.getmembers():
                    if info.isfile() and info.name not in drop:
                        target.writestr(info.name, archive.extractfile(info).read())
    return out.getvalue()
