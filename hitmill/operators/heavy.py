"""The most frequent values without a shuffle of all values.

A sketch of bounded size per task gives the candidates and a bound on what it may have missed; then
the candidates alone are counted exactly. If the bound does not prove that no other value belongs
to the top, the sketch grows, and at last all values are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmill.functions.ordering import down, top, up

# Values a sketch tracks at first and at most, and by how much it grows.
TRACKED = 10_000
MOST_TRACKED = 640_000
GROWTH = 8
# Of all rows, a sketch for n values misses at most this share / n of any value (its published bound).
MISSED = 3.5


def top_counts(
    hits: DataFrame,
    keys: Sequence[str],
    k: int = 10,
    where: Column | None = None,
    tracked: int = TRACKED,
    most: int = MOST_TRACKED,
) -> DataFrame:
    """The ``k`` most frequent values of ``keys`` with their exact counts ``c`` (ties by key).

    Values are tracked by a 64-bit hash; different values of one hash are candidates together
    and counted apart. Runs a job per attempt; what reaches the driver and is broadcast are at
    most ``most`` hashes.
    """
    rows = hits if where is None else hits.where(where)
    rows = rows.select(*keys, F.xxhash64(*keys).alias("_hash"))
    total = None
    while tracked <= most:
        sketch = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.call_function("approx_top_k_accumulate", "_hash", F.lit(tracked)).alias("sketch"),
        )
        found = sketch.select(
            "n", F.call_function("approx_top_k_estimate", "sketch", F.lit(tracked)).alias("top")
        ).first()
        total, items = found.n, found.top or []
        if not total:
            break
        # Counts that add up to all rows are exact, and nothing was missed.
        whole = sum(item["count"] for item in items) == total
        missed = 0 if whole else max(MISSED * total / tracked, items[-1]["count"] if len(items) == tracked else 0)
        # The estimates are upper bounds: not even all of them could prove it.
        if whole or len(items) >= k and items[k - 1]["count"] > missed:
            table = hits.sparkSession.createDataFrame([(item["item"],) for item in items], "_hash bigint")
            counted = rows.join(F.broadcast(table), "_hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
            best = top(counted, k, down("c"), *map(up, keys))
            least = best.agg(F.min("c"), F.count(F.lit(1))).first()
            if whole or least[1] == k and least[0] > missed:
                return best
        tracked *= GROWTH
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return top(counted, k, down("c"), *map(up, keys))
