"""Commit histories as CSV with a header: revision, time, url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMMITS_SCHEMA = "revision string, time timestamp, url string"


def load_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMITS_SCHEMA).option("header", True).csv(path)


def load_adhoc_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header, types inferred from the data (reads it twice)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
