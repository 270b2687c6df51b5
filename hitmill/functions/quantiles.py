"""Exact percentiles per group that survive very large groups.

Spark's ``percentile`` keeps one counter per distinct value of a group in the
memory of one task. Here all groups, of any size, take the same lazy plan: the rows
are counted per bucket of values with a map-side combine, the buckets that hold the
wanted ranks follow from the counts, and only the values of those buckets are counted and
ranked. No job runs while the plan is built.

Groups and buckets are told apart by 128-bit hashes on the way of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitmill.functions.ranks import bucket, upto


def group_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: Sequence[Column] = (),
    name: str = "median",
    weight: str | None = None,
) -> DataFrame:
    """``group_percentile`` at one half."""
    return group_percentile(df, keys, value, 0.5, extra, name, weight)


def group_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fraction: float,
    extra: Sequence[Column] = (),
    name: str = "percentile",
    weight: str | None = None,
) -> DataFrame:
    """The exact interpolated percentile of ``value`` per group.

    ``extra`` holds aliased aggregates with bounded state that are computed beside
    the percentile. The columns of the result are the keys, the extras and ``name``.
    Groups without any value keep a NULL percentile. ``weight`` names a column of positive
    whole numbers: a row stands for so many equal ones.
    """
    keys = list(keys)
    times = F.lit(1) if weight is None else F.col(weight).cast("long")
    rows = df.withColumns({"_value": F.col(value).cast("double"), "_times": times})
    rows = rows.withColumn("_bucket", bucket(F.col("_value")))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.sum("_times").alias("_held"))
    wanted = _wanted(sizes, keys, fraction)
    # All rows cross one shuffle, with 128 bits that stand for the group and bucket.
    slots = [slot.alias(f"_slot{i}") for i, slot in enumerate(_slots([*keys, "_bucket"]))]
    inside = rows.select(*slots, "_value", "_times").join(wanted, ["_slot0", "_slot1"])
    counts = inside.groupBy(*keys, "_bucket", "_before", "_position", "_value").agg(
        F.sum("_times").alias("_n")
    )
    ranked = counts.withColumn(
        "_end", F.col("_before") + F.sum("_n").over(upto([*keys, "_bucket"], "_value"))
    )
    low, high = F.floor("_position"), F.ceil("_position")

    def value_at(rank: Column) -> Column:
        return F.when((F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end")), F.col("_value"))

    found = ranked.select(
        *keys, value_at(low).alias("_at_low"), value_at(high).alias("_at_high"), "_position"
    )
    # The groups and their extras come in as further rows instead of by a join.
    groups = df.groupBy(*keys).agg(*extra) if extra else sizes.select(*keys).distinct()
    names = [column for column in groups.columns if column not in keys]
    both = found.unionByName(groups, allowMissingColumns=True)
    one = both.groupBy(*keys).agg(
        *[F.first(column, ignorenulls=True).alias(column) for column in names],
        *[F.max(column).alias(column) for column in ("_at_low", "_at_high", "_position")],
    )
    # The interpolation of Spark's own percentile, equal to the bit.
    between = (F.ceil("_position") - F.col("_position")) * F.col("_at_low") + (
        F.col("_position") - F.floor("_position")
    ) * F.col("_at_high")
    alike = F.col("_at_low") == F.col("_at_high")
    return one.select(*keys, *names, F.when(alike, F.col("_at_low")).otherwise(between).alias(name))


def _wanted(sizes: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """The one or two buckets of every group that hold its wanted ranks."""
    held = sizes.where(F.col("_bucket").isNotNull())
    placed = (
        held.withColumn("_before", F.sum("_held").over(upto(keys, "_bucket")) - F.col("_held"))
        .withColumn("_total", F.sum("_held").over(Window.partitionBy(*keys)))
        .withColumn("_position", (F.col("_total") - 1) * F.lit(float(fraction)))
    )
    holds = (F.col("_before") <= F.ceil("_position")) & (
        F.col("_before") + F.col("_held") > F.floor("_position")
    )
    return placed.where(holds).select(
        *keys,
        "_bucket",
        "_before",
        "_position",
        *[slot.alias(f"_slot{i}") for i, slot in enumerate(_slots([*keys, "_bucket"]))],
    )


def _slots(names: list[str]) -> list[Column]:
    """Two hashes of several columns, 128 bits together; NULL differs from all values."""
    marked = [part for name in names for part in (F.isnull(name), F.col(name))]
    return [F.xxhash64(F.lit(i), *marked) for i in (0, 1)]
