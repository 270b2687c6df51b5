"""Summaries of hits per day that merge into answers over all days.

A new day adds rows of its own and nothing else is read again: quantile sketches for the
tail of response times, exact bitmaps for counts of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitmill.functions.ordering import down, top, up

DAY = "EventDate"
# Size of a sketch: 200 gives a rank error of about 1.65 %, and groups up to that many rows are exact.
SKETCH = 200


# --- quantiles --------------------------------------------------------------


def tail_sketches(
    hits: DataFrame,
    keys: Sequence[str] = ("ClientIP", "WatchID"),
    value: str = "ResponseStartTiming",
    size: int = SKETCH,
) -> DataFrame:
    """Rows, least and largest value and a quantile sketch of each group and day.

    Sketches have a bounded size, and combine before the shuffle. Groups without any value
    have no sketch.
    """
    number = F.col(value).cast("bigint")
    return hits.groupBy(DAY, *keys).agg(
        F.count(F.lit(1)).alias("c"),
        F.min(value).alias("tmin"),
        F.max(value).alias("tmax"),
        F.count(value).alias("held"),
        F.call_function("kll_sketch_agg_bigint", number, F.lit(size)).alias("sketch"),
    )


def merged_tail(
    sketches: DataFrame,
    fraction: float = 0.95,
    k: int = 10,
    keys: Sequence[str] = ("ClientIP", "WatchID"),
) -> DataFrame:
    """The groups of two rows or more with the slowest tail over all days of ``sketches``."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("c").alias("c"),
        F.min("tmin").alias("tmin"),
        F.max("tmax").alias("tmax"),
        F.sum("held").alias("held"),
        F.call_function("kll_merge_agg_bigint", "sketch").alias("sketch"),
    )
    tail = F.call_function("kll_sketch_get_quantile_bigint", "sketch", F.lit(fraction).cast("double"))
    found = merged.where(F.col("c") > 1).select(
        *keys, "c", "tmin", F.when(F.col("held") > 0, tail).alias("tp95"), "tmax"
    )
    return top(found, k, down("tp95"), *map(up, keys))


# --- distinct counts --------------------------------------------------------


def number_values(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A dense number (``id``, from 0) for each distinct ``value`` that ``known`` does not have.

    Each task numbers its own values; what the tasks before it hold is added. Returns the new rows
    only, to be stored (before they are used twice) and appended to the known ones.
    """
    new = values.select("value").where(F.col("value").isNotNull()).distinct()
    base = F.lit(0)
    if known is not None:
        new = new.join(known, "value", "left_anti")
        base = F.coalesce(F.lit(known.agg(F.max("id") + 1).first()[0]), F.lit(0))
    # The task's number above 33 bits, the row's number in the task below.
    mark = F.monotonically_increasing_id()
    placed = new.select("value", mark.alias("mark")).select(
        "value",
        F.shiftright("mark", 33).alias("task"),
        F.col("mark").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    sizes = placed.groupBy(F.col("task").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    # One row per task.
    ahead = sizes.select("of", (F.sum("n").over(Window.orderBy("of")) - F.col("n")).alias("ahead"))
    return placed.join(ahead, F.col("task") == F.col("of")).select(
        "value", (base + F.col("ahead") + F.col("place")).alias("id")
    )


def daily_bitmaps(hits: DataFrame, ids: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The distinct values of every day and group as bitmaps over their numbers.

    A row holds the 32768 numbers of one bucket in 4 KB, whatever it holds of them, so this is for
    groups that are few beside their values, such as regions or days.
    """
    seen = hits.select(DAY, *keys, F.col(value).alias("value")).distinct()
    numbered = seen.join(ids, "value")
    bucket = F.bitmap_bucket_number("id").alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    return numbered.groupBy(DAY, *keys, bucket).agg(bits)


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str] = (), name: str = "u") -> DataFrame:
    """How many distinct values each group has over all days of ``bitmaps``."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counts = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("bigint")).alias(name)
    return merged.groupBy(*keys).agg(counts) if keys else merged.agg(counts)
