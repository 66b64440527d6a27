"""Pictures to feature rows: decoded in the JVM, measured in batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pictures
from ..functions.paths import basename
from ..operators.tables import shared_folder, stored
from . import archives

_FEATURES = (
    "path string, width int, height int, phash bigint, phash_rot map<int,bigint>, grid array<bigint>, grid_rot map<int,array<bigint>>, "
    "phash_256 binary, phash_1024 binary, whash bigint, hsv struct<h:float,s:float,v:float>, is_colorful boolean, "
    "qr_points array<array<struct<x:double,y:double>>>, features_at int, error string"
)
_NAMES = [c.split()[0] for c in ("path", "width", "height", "phash", "phash_rot", "grid", "grid_rot", "phash_256", "phash_1024", "whash", "hsv", "is_colorful", "qr_points", "features_at", "error")]


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's decoded bytes (blue first) as red, green, blue."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2)
    return x[..., 2::-1] if channels in (3, 4) else x[..., :3]


def features(spark: SparkSession, root: str, want: pictures.Wanted = pictures.Wanted(), wanted_paths: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Feature rows of all pictures below ``root``, or of those whose path ``wanted_paths`` lists.

    A picture that can't be decoded or measured gives a row with its error.
    """
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    rows = found.select(F.regexp_replace("image.origin", "^file:/{1,3}", "/").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    if wanted_paths is not None:
        rows = rows.join(wanted_paths.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    if r.height <= 0 or r.width <= 0:
                        raise ValueError("not a picture")
                    own = pictures.features(pixels(bytes(r.data), r.height, r.width, r.channels), want)
                except (ValueError, IndexError, np.linalg.LinAlgError) as x:
                    own = {"error": f"{type(x).__name__}: {x}"}
                out.append({"path": r.path} | own)
            frame = pd.DataFrame(out, columns=_NAMES).astype(object)
            yield frame.where(frame.notna(), None)

    return rows.mapInPandas(run, _FEATURES)


def archive_features(spark: SparkSession, root: str, want: pictures.Wanted = pictures.Wanted(), last: int | None = None) -> DataFrame:  # noqa: B008
    """Feature rows of pictures in archives below ``root``, by their virtual paths; with ``last`` of each archive's last ones.

    Members are written to the shared folder, where the JVM decodes them as it does loose pictures.
    """
    found = archives.read(spark, root, with_content=True).where("inner is not null")
    rows = found if last is None else archives.last_members(found, last)
    out = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    files = stored(archives.unpacked(rows, out))
    if not files.limit(1).count():
        return spark.createDataFrame([], _FEATURES)
    own = features(spark, out, want).withColumn("file", basename(F.col("path"))).drop("path")
    return files.join(own, "file").select(*_NAMES)
