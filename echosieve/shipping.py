"""The package itself, sent to the executors of a session that may not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to what Spark gives each worker, once a session."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="echosieve-package-")) / "echosieve.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(top.rglob("*.py")):
            out.write(module, module.relative_to(top.parent))
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)
