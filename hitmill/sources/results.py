"""The table of query timings as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

# The columns of a result row, in file order.
RESULTS_SCHEMA = (
    "benchmark_name string, query_name string, query_type string, execution_time double, "
    "run_timestamp string, git_revision string, git_revision_timestamp string, num_cores bigint"
)
RESULTS_COLUMNS = [
    "benchmark_name",
    "query_name",
    "query_type",
    "execution_time",
    "run_timestamp",
    "git_revision",
    "git_revision_timestamp",
    "num_cores",
]


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    """All results files that match a path pattern; the schema is not inferred.

    A header with other columns or another order, and a value of another type, fail the read.
    """
    return strict_csv(spark).schema(RESULTS_SCHEMA).csv(pattern)


def strict_csv(spark: SparkSession) -> DataFrameReader:
    """A CSV reader that takes no column for another and turns no bad value into NULL."""
    return spark.read.options(header=True, enforceSchema=False, mode="FAILFAST")


def append_results(results: DataFrame, path: str, form: str = "csv") -> None:
    """Append rows to a results folder.

    Every task adds a file of its own, with a header in CSV. ``form="parquet"``
    is the better choice for large tables.
    """
    writer = results.select(*RESULTS_COLUMNS).write.mode("append")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)
