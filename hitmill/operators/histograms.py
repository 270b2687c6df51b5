"""Timings as signed counts of values, kept up to date instead of computed anew.

Appended runs count up, removed runs count down. Minima, means and exact medians follow from
the merged counts, so an append touches what it brings and not the runs stored before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.functions.quantiles import group_median
from hitmill.operators.regress import OFFSET_SECONDS, query_rows

KEYS = ["git_revision", "git_revision_timestamp", "query_name", "execution_time"]


def value_counts(results: DataFrame, sign: int = 1) -> DataFrame:
    """How often each revision has each time of each query (``n``); ``sign`` -1 takes runs out."""
    return query_rows(results).groupBy(*KEYS).agg((F.count(F.lit(1)) * sign).alias("n"))


def merged(*counts: DataFrame) -> DataFrame:
    """The sum of several counts, without what cancels out.

    More taken out than there was leaves a negative count: it fails when it is read.
    """
    every = reduce(DataFrame.unionByName, counts)
    sums = every.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    checked = F.when(F.col("n") > 0, F.col("n")).otherwise(
        F.raise_error(F.lit("more runs were removed than stored")).cast("bigint")
    )
    return sums.select(*KEYS, checked.alias("n"))


def baseline(counts: DataFrame) -> DataFrame:
    """The fastest time of every query over all revisions."""
    return counts.groupBy("query_name").agg(F.min("execution_time").alias("baseline_time"))


def normalize(counts: DataFrame, best: DataFrame | None = None, offset: float = OFFSET_SECONDS) -> DataFrame:
    """The counts with times relative to the fastest of their query."""
    best = baseline(counts) if best is None else best
    relative = (F.lit(offset) + F.col("execution_time")) / (F.lit(offset) + F.col("baseline_time"))
    return counts.join(best, "query_name").select(*KEYS, "n", relative.alias("normalized_time"))


def trend(normalized: DataFrame) -> DataFrame:
    """Mean and median of the normalised runs of every revision."""
    mean = F.sum(F.col("normalized_time") * F.col("n")) / F.sum(F.when(F.col("normalized_time").isNotNull(), F.col("n")))
    return group_median(
        normalized,
        ["git_revision", "git_revision_timestamp"],
        "normalized_time",
        [mean.alias("avg_time")],
        "median_time",
        "n",
    )


def per_query(normalized: DataFrame) -> DataFrame:
    """Median of the normalised runs of every revision and query."""
    return group_median(
        normalized,
        ["git_revision", "git_revision_timestamp", "query_name"],
        "normalized_time",
        name="median_time",
        weight="n",
    )
