"""Queries over generated files: pictures and archives; and the streaming merge."""

from __future__ import annotations

import io
import os
import struct
import tempfile
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pictures import Wanted
from ..operators.tables import shared_folder
from ..sources import archives, pictures
from ..sources.snapshots import Snapshots
from ..streaming import incremental
from .tables import table


def png(image: np.ndarray) -> bytes:
    """A picture as an uncompressed-filter PNG."""
    h, w, _ = image.shape
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def sample_picture(i: int, side: int = 96) -> np.ndarray:
    """A smooth picture that differs for each i; every third repeats the one before with noise."""
    rng = np.random.default_rng(i - (i % 3 == 2))
    y, x = np.mgrid[0:side, 0 : side + 32] / side
    waves = sum(rng.normal() * np.cos(2 * np.pi * (rng.integers(1, 5) * x + rng.integers(1, 5) * y) + rng.normal()) for _ in range(6))
    base = 128 + 40 * waves[..., None] * rng.uniform(0.4, 1.0, 3)
    return np.clip(base + (np.random.default_rng(1000 + i).normal(0, 2, base.shape) if i % 3 == 2 else 0), 0, 255).astype(np.uint8)


def _local(spark: SparkSession) -> str:
    """A new folder in the shared one, for files that the driver generates; it must be a mounted one."""
    base = shared_folder(spark)
    if not base.startswith(("file:", "/")):
        raise ValueError("generated files need a shared folder that is mounted")
    top = "/" + base.removeprefix("file:").lstrip("/")
    os.makedirs(top, exist_ok=True)
    return tempfile.mkdtemp(dir=top, prefix="media-")


def phash_image(spark: SparkSession, d: str) -> DataFrame:
    """Features of 30 generated pictures."""
    top = _local(spark)
    for i in range(30):
        with open(f"{top}/p{i:02d}.png", "wb") as out:
            out.write(png(sample_picture(i)))
    found = pictures.features(spark, top, Wanted(rotations=True))
    return found.select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "width", "height", "phash", "whash", F.size("grid").alias("cells"),
        F.element_at("phash_rot", 180).alias("phash_180"), F.bround("hsv.h", 2).cast("double").alias("hue"), "is_colorful", "features_at", "error",
    )


def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """The last two pictures of each of ten generated archives."""
    top = _local(spark)
    for i in range(10):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k in range(i + 1):
                z.writestr(f"page{k}.png", b"x" * k)
            z.writestr("notes.txt", b"")
        with open(f"{top}/a{i}.cbz", "wb") as out:
            out.write(data.getvalue())
    found = archives.last_members(archives.read(spark, top), 2)
    return found.select(F.regexp_extract("archive", "([^/]*)$", 1).alias("archive"), "inner", "length", "rank")


def streaming_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events merged into a snapshot by user, in batches that all have rows of all users, keeping the greatest event of each."""
    top = _local(spark)
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    for i in (2, 0, 3, 1):
        events.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"file://{top}/in")
    snapshots = Snapshots(spark, f"file://{top}/state", "user_id")
    schema = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string"
    incremental.upsert(incremental.rows(spark, f"file://{top}/in", schema, 1), snapshots, f"file://{top}/check", "event_id").awaitTermination()
    return snapshots.read()


def archive_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Features of the last three pictures of each of four generated archives."""
    top = _local(spark)
    for i in range(4):
        with zipfile.ZipFile(f"{top}/a{i}.cbz", "w") as z:
            for k in range(i + 2):
                z.writestr(f"page{k}.png", png(sample_picture(5 * i + k)))
    found = pictures.archive_features(spark, top, last=3)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("page"), "width", "height", "phash", "whash", "error")


_Q = (phash_image, archive_members, archive_pictures, streaming_upsert)
QUERIES = {q.__name__: q for q in _Q}

SQL = {
    "archive_members": """SELECT 'a' || i::VARCHAR || '.cbz' AS archive, 'page' || k::VARCHAR || '.png' AS inner, k AS length, (i - k + 1)::INTEGER AS rank
FROM (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 10)) AS k) WHERE k <= i AND k >= i - 1""",
    "streaming_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
}
