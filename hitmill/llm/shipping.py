"""Bring this library's code to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import hitmill

_shipped: set[str] = set()

# Texts that meet a Python worker at once. Counted in rows alone, a batch of 10000 texts takes tens of MB
# several times over: outside the executor's heap, and in its worker.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the application once, as ``--py-files`` would.

    Spark's own file server hands the archive to executors, those that join later included.
    Batches for Python workers are bounded in bytes as well, unless the session sets a bound of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(hitmill.__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="hitmill-code-"), "hitmill.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, Path(root.name) / source.relative_to(root))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
