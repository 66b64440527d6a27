"""Tables written to the folder all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Return the session's ``spark.checkpoint.dir``.

    Only a local master, where every task shares the driver's disk, may do without that setting;
    it then gets a temporary folder that goes when the process ends.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="echosieve-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """Return a path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's setting for deleting the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read from there.

    What the query shuffled is deleted when the table stands, so the disk holds one step's shuffles at a time.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned and that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
