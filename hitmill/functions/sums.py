"""Sums that share one pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shifted_sums(df: DataFrame, x: str, shifts: Iterable[int], prefix: str = "s") -> DataFrame:
    """``SUM(x + k)`` for every ``k`` as ``SUM(x) + k * COUNT(x)``, one row.

    NULLs are skipped by both sides, and an empty input gives NULL in both. All
    results share one SUM and one COUNT buffer, where the plain form keeps one
    buffer per shift.
    """
    shared = df.agg(F.sum(F.col(x).cast("bigint")).alias("_sum"), F.count(x).alias("_count"))
    return shared.selectExpr(*[f"_sum + {k}L * _count AS {prefix}{k}" for k in shifts])
