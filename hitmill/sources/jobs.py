"""Job scripts as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_jobs(spark: SparkSession, path: str, pattern: str = "*.sh") -> DataFrame:
    """Job files as (job, modified, text); finished ones do not match the pattern."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return files.select(
        F.col("_metadata.file_name").alias("job"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )
