"""Comments on pull requests, as JSON records or already flat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields that are used of a comment record.
COMMENTS_JSON = (
    "id bigint, body string, user struct<login: string>, html_url string, "
    "issue_url string, created_at timestamp, updated_at timestamp"
)
COMMENTS_SCHEMA = (
    "id bigint, repo string, login string, body string, html_url string, "
    "issue_url string, created_at timestamp, updated_at timestamp"
)


def flatten(records: DataFrame, repo) -> DataFrame:
    """Records with a nested user as flat comments; missing text becomes empty."""
    texts = {
        "login": F.col("user.login"),
        "body": F.col("body"),
        "html_url": F.col("html_url"),
        "issue_url": F.col("issue_url"),
    }
    return records.select(
        "id",
        repo.alias("repo"),
        *[F.coalesce(column, F.lit("")).alias(name) for name, column in texts.items()],
        "created_at",
        "updated_at",
    )


def load_comments(spark: SparkSession, path: str, repo: str, array_files: bool = False) -> DataFrame:
    """Comment records of one repository from JSON lines (or JSON array files).

    A broken record fails the read.
    """
    reader = spark.read.schema(COMMENTS_JSON).options(multiLine=array_files, mode="FAILFAST")
    return flatten(reader.json(path), F.lit(repo))


def stream_records(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Comment records of one repository as JSON lines files arrive in a folder."""
    reader = spark.readStream.schema(COMMENTS_JSON).option("mode", "FAILFAST")
    return flatten(reader.json(path), F.lit(repo))


def stream_comments(spark: SparkSession, path: str) -> DataFrame:
    """Flat comments from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(COMMENTS_SCHEMA).parquet(path)
