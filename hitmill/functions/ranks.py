"""Ranks within groups of any size.

Values become buckets that keep their order. Bucket sizes are few, so they are added up in
order per group; what lies below a value is then known from its bucket and from the other
values of the same bucket. No task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets are equally wide in log(1 + |value|), this many to a factor of e. The values
# of one bucket and group are sorted by one task, which may spill.
BUCKETS = 4096


def bucket(value: Column) -> Column:
    """A number that never falls while ``value`` rises; NaN counts as the largest value."""
    scaled = F.floor(F.signum(value) * F.log1p(F.abs(value)) * BUCKETS)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(scaled)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "") -> Column:
    """All keys equal, NULL to NULL."""
    return reduce(Column.__and__, [left[key].eqNullSafe(right[prefix + key]) for key in keys])


def upto(keys: Sequence[str], order: str):
    """The rows of a group up to the current one."""
    window = Window.partitionBy(*keys).orderBy(order)
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def below(counts: DataFrame, keys: Sequence[str], value: str, amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the smaller values of the group.

    ``counts`` has one row per group and value; rows without a value are dropped.
    """
    keys = list(keys)
    held = counts.where(F.col(value).isNotNull()).withColumn("_bucket", bucket(F.col(value)))
    sizes = held.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_size"))
    before = sizes.select(
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        F.col("_bucket").alias("_k__bucket"),
        (F.sum("_size").over(upto(keys, "_bucket")) - F.col("_size")).alias("_before"),
    )
    placed = held.join(before, same(held, before, [*keys, "_bucket"], "_k_"))
    inside = F.sum(amount).over(upto([*keys, "_bucket"], value)) - F.col(amount)
    return placed.select(*counts.columns, (F.col("_before") + inside).alias(name))
