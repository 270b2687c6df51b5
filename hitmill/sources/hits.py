"""The wide ``hits`` table as a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_hits(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    files: list[str] | None = None,
) -> DataFrame:
    """Read a hits directory, with binary columns as text and EventDate as a date.

    ``files``: only these files of it.

    Binary columns are declared as strings in the schema of the scan instead of
    being cast, so filters on them still reach Parquet.
    """
    found = schema or spark.read.parquet(path).schema
    declared = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.dataType == T.BinaryType() else f.dataType)
            for f in found
        ]
    )
    reader = spark.read.schema(declared).option("basePath", path)
    return with_event_date(reader.parquet(*(files or [path])))


def with_event_date(hits: DataFrame) -> DataFrame:
    """EventDate as a DATE, from a day number or an ISO text if need be."""
    kind = hits.schema["EventDate"].dataType
    if isinstance(kind, T.DateType):
        return hits
    if isinstance(kind, T.IntegralType):
        return hits.withColumn("EventDate", F.date_from_unix_date(F.col("EventDate").cast("int")))
    return hits.withColumn("EventDate", F.to_date("EventDate"))


def write_hits(hits: DataFrame, path: str, blooms: dict[str, int] | None = None) -> None:
    """Write a hits directory with one folder per day.

    ``rebalance`` gathers the rows of a day, splits a hot day over several tasks
    and joins small ones, all by size at run time. The sort inside the files
    gives narrow CounterID and EventTime ranges per row group, which the
    page-view queries and the time-ordered lookups skip on.

    ``blooms``: columns that get a Bloom filter per row group, and how many distinct
    values of theirs a row group holds. A lookup by such a column reads only row groups that
    may hold the value, although the files are not sorted by it.
    """
    writer = (
        hits.hint("rebalance", "EventDate")
        .sortWithinPartitions("EventDate", "CounterID", "EventTime")
        .write.partitionBy("EventDate")
    )
    for column, values in (blooms or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    writer.parquet(path)
