"""Revision labels: JSON arrays of {revision, label, PR}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS_SCHEMA = "array<struct<revision: string, label: string, PR: string>>"


def parse_labels(documents: DataFrame) -> DataFrame:
    """One row per array element of (document, text) rows, with its position.

    Text that is not such an array fails the read.
    """
    parsed = F.from_json("text", LABELS_SCHEMA, {"mode": "FAILFAST"})
    items = documents.select("document", parsed.alias("items"))
    return items.select("document", F.posexplode("items").alias("position", "item")).select(
        F.col("item.revision").alias("revision"),
        F.col("item.label").alias("label"),
        F.col("item.PR").alias("pr"),
        F.struct("document", "position").alias("position"),
    )


def last_labels(labels: DataFrame) -> DataFrame:
    """One row per revision; the last of several labels wins."""
    last = F.max_by(F.struct("label", "pr", "position"), "position")
    return (
        labels.groupBy("revision")
        .agg(last.alias("last"))
        .select("revision", "last.label", "last.pr", "last.position")
    )


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """All label files of a path; several files count in path order."""
    files = spark.read.text(path, wholetext=True)
    return parse_labels(
        files.select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("text"))
    )
