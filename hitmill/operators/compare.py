"""Comparison of revisions by the median time of every query, and by a test of all its times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.functions.normal import quantile, two_sided
from hitmill.functions.quantiles import group_median
from hitmill.functions.ranks import below
from hitmill.operators.regress import query_rows

# A ratio this close to one counts as no change.
NOISE = 0.05
# A difference counts if chance gives one as large less often than this.
ALPHA = 0.05
# How often a test is to notice the smallest ratio it is said to detect.
POWER = 0.8


def medians(results: DataFrame, revisions: Sequence[str]) -> DataFrame:
    """Median time per query of the given revisions only."""
    wanted = query_rows(results).where(F.col("git_revision").isin(*revisions))
    return group_median(
        wanted,
        ["query_name", "git_revision"],
        "execution_time",
        name="median_time",
    )


def compare_two(
    results: DataFrame,
    base: str,
    candidate: str,
    noise: float = NOISE,
) -> DataFrame:
    """Both medians per query, their ratio and a verdict.

    A query that only one side has is kept and names the side it is missing on.
    """
    both = medians(results, [base, candidate])
    sides = both.groupBy("query_name").agg(
        F.max(F.when(F.col("git_revision") == base, F.col("median_time"))).alias("base_time"),
        F.max(F.when(F.col("git_revision") == candidate, F.col("median_time"))).alias(
            "candidate_time"
        ),
    )
    ratio = F.try_divide("candidate_time", "base_time")
    return sides.select(
        "query_name",
        "base_time",
        "candidate_time",
        ratio.alias("ratio"),
        F.when(F.col("base_time").isNull(), "missing in base")
        .when(F.col("candidate_time").isNull(), "missing in candidate")
        .when(ratio < 1 - noise, "faster")
        .when(ratio > 1 + noise, "slower")
        .otherwise("same")
        .alias("verdict"),
    )


def significance(
    results: DataFrame,
    base: str,
    candidate: str,
    alpha: float = ALPHA,
    power: float = POWER,
) -> DataFrame:
    """Per query, whether the times of two revisions differ by more than their spread explains.

    A two-sided rank-sum test with corrections for ties and continuity. ``u`` counts the pairs of
    a base run and a slower candidate run (ties are halves), ``slower_share`` is its share
    of all pairs, ``p_value`` the chance of a share as far from one half among like
    runs. The verdict is "same" unless p_value < alpha. ``detectable_ratio`` is the smallest ratio of
    times that so many runs, spread as they are in log time, show with probability
    ``power``; without spread to measure (one run of each, no positive time) it is NULL.

    All comes from counts per distinct time, added up in buckets, so no task ranks
    all runs of a query. A query that only one side has names the side it is missing on.
    """
    is_base, is_candidate = F.col("git_revision") == base, F.col("git_revision") == candidate
    wanted = query_rows(results).where(F.col("git_revision").isin(base, candidate))
    wanted = wanted.where(F.col("execution_time").isNotNull())
    counts = wanted.groupBy("query_name", "execution_time").agg(
        F.count_if(is_base).alias("a"), F.count_if(is_candidate).alias("b")
    )
    tied = (F.col("a") + F.col("b")).cast("double")
    pairs = below(counts, ["query_name"], "execution_time", "a", "smaller")
    sums = pairs.groupBy("query_name").agg(
        F.sum("a").alias("base_runs"),
        F.sum("b").alias("candidate_runs"),
        F.sum(F.col("b") * (F.col("smaller") + F.col("a") / 2)).alias("u"),
        F.sum(tied * tied * tied - tied).alias("ties"),
    )
    log = F.when(F.col("execution_time") > 0, F.ln("execution_time"))
    spread = wanted.groupBy("query_name").agg(
        F.var_samp(F.when(is_base, log)).alias("base_var"),
        F.var_samp(F.when(is_candidate, log)).alias("candidate_var"),
    )
    n1, n2 = F.col("base_runs").cast("double"), F.col("candidate_runs").cast("double")
    n, half = n1 + n2, n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    off = F.col("u") - half
    z = F.when(sigma > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / sigma).otherwise(0.0)
    both = (n1 > 0) & (n2 > 0)
    reach = (quantile(1 - alpha / 2) + quantile(power)) * math.sqrt(math.pi / 3)
    detectable = F.exp(reach * F.sqrt(F.col("base_var") / n1 + F.col("candidate_var") / n2))
    tested = sums.join(spread.withColumnRenamed("query_name", "_query"), F.col("query_name").eqNullSafe(F.col("_query")))
    tested = tested.withColumn("z", F.when(both, z)).withColumn("p_value", two_sided(F.col("z")))
    return tested.select(
        "query_name",
        "base_runs",
        "candidate_runs",
        F.when(both, F.col("u")).alias("u"),
        F.when(both, F.col("u") / (n1 * n2)).alias("slower_share"),
        "z",
        F.when(both, F.col("p_value")).alias("p_value"),
        F.when(both, detectable).alias("detectable_ratio"),
        F.when(n1 == 0, "missing in base")
        .when(n2 == 0, "missing in candidate")
        .when(F.col("p_value") >= alpha, "same")
        .when(F.col("z") > 0, "slower")
        .otherwise("faster")
        .alias("verdict"),
    )


def compare_many(results: DataFrame, revisions: Sequence[str]) -> DataFrame:
    """One column of medians per revision, one row per query."""
    wide = medians(results, revisions)
    return wide.groupBy("query_name").pivot("git_revision", list(revisions)).agg(
        F.max("median_time")
    )


def select_benchmarks(
    results: DataFrame, pattern: str | None = None, suites: Sequence[str] | None = None
) -> DataFrame:
    """Results whose query matches a pattern and whose benchmark is in a list."""
    if pattern is not None:
        results = results.where(F.col("query_name").rlike(pattern))
    if suites is not None:
        results = results.where(F.col("benchmark_name").isin(*suites))
    return results
