"""Orderings that do not depend on the engine's NULL placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def up(name: str) -> Column:
    return F.asc_nulls_last(name)


def down(name: str) -> Column:
    return F.desc_nulls_last(name)


def top(df: DataFrame, k: int, *order: Column, offset: int = 0) -> DataFrame:
    """The first ``k`` rows after ``offset`` rows in the given order.

    Plans as TakeOrderedAndProject: every task keeps ``offset + k`` rows and no
    full sort is shuffled.
    """
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(k)
