"""Hits as a table of the catalog: partitions, statistics and buckets the optimiser knows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "EventDate"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def register_hits(spark: SparkSession, path: str, schema: T.StructType, name: str = "hits") -> DataFrame:
    """An external table over a hits directory with one folder per day.

    The catalog keeps the list of days, so a query names its folders without listing the
    others. Days that are written later are found by ``refresh_days``.
    """
    spark.sql(
        f"CREATE TABLE {name} ({_columns(schema)}) USING parquet PARTITIONED BY ({DAY}) LOCATION '{path}'"
    )
    refresh_days(spark, name)
    return spark.table(name)


def refresh_days(spark: SparkSession, name: str = "hits") -> None:
    """Add the days whose folders appeared, drop those whose folders went."""
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")


def analyze(spark: SparkSession, name: str, columns: Sequence[str], days: bool = True) -> None:
    """Row count, sizes per day, and statistics with histograms of some columns."""
    if days:
        spark.sql(f"ANALYZE TABLE {name} PARTITION ({DAY}) COMPUTE STATISTICS")
    with _setting(spark, "spark.sql.statistics.histogram.enabled", "true"):
        listed = ", ".join(f"`{c}`" for c in columns)
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {listed}")


def write_bucketed(hits: DataFrame, path: str, name: str, buckets: int, key: str = "UserID") -> DataFrame:
    """Write hits as an external table bucketed and sorted by ``key``.

    Groupings and joins by the key need no shuffle of their own. A bucket is a unit of
    work: take so many that one fits a task. The rows of a bucket are gathered by
    size, so that a bucket with a hot key is written by several tasks, as several files.
    """
    number = F.pmod(F.hash(key), F.lit(buckets))
    placed = hits.withColumn("_bucket", number).hint("rebalance", F.col("_bucket")).drop("_bucket")
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return hits.sparkSession.table(name)
