"""Engine output as text files, one file per query run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (log, line_no, line).

    Large files are split over tasks. ``line_no`` orders the lines of one file:
    first by the split's offset in the file, then by the order inside the split.
    It is no consecutive count.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("log"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def load_names(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File names below a folder that match a glob, without reading the files."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path")
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
