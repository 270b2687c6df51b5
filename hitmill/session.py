"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator assumes. They are all runtime settings, so they can be
# applied to a session somebody else built.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    # A hot key must not keep later, finer groupings in one task: aggregates shuffle on
    # all of their keys, and skewed joins are split even if that costs a shuffle.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to an existing session."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "hitmill", cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the session comes from spark-submit, which also names
    ``spark.checkpoint.dir``; only this local builder picks a folder by itself.
    """
    partitions = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        # No call-site capture for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hitmill-checkpoint-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
