"""Exact percentiles, also of groups that no task may hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitmill.functions.quantiles import group_median, group_percentile


def brute(rows, fraction):
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).append(v)
    return {
        key: (
            len(values),
            float(np.percentile([v for v in values if v is not None], fraction * 100))
            if any(v is not None for v in values)
            else None,
        )
        for key, values in groups.items()
    }


def skewed_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(6000):
        # One group holds a third of all rows; keys and values can be NULL.
        key = ("hot", 1) if i % 3 == 0 else (rng.choice(["x", "y", None]), rng.choice([1, 2, None]))
        value = None if rng.random() < 0.1 else rng.choice([rng.random() * 100, float(i % 17)])
        rows.append((*key, value))
    rows += [("empty", 1, None)] * 400 + [("one", 1, 2.5)] + [("same", 1, 7.0)] * 500
    return rows


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_matches_brute_force(spark, fraction):
    rows = skewed_rows(7)
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(5)
    got = group_percentile(
        df, ["a", "b"], "v", fraction, [F.count(F.lit(1)).alias("n")], "p"
    ).collect()
    want = brute(rows, fraction)
    assert len(got) == len(want)
    for row in got:
        n, p = want[(row.a, row.b)]
        assert row.n == n
        assert (row.p is None) == (p is None)
        assert p is None or math.isclose(row.p, p, rel_tol=1e-12)


def test_integers_and_no_extra(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("int").alias("v"))
    got = {r.k: r.median for r in group_median(df, ["k"], "v").collect()}
    assert got == {0: 499.0, 1: 500.0}


def test_equals_the_built_in_percentile(spark):
    """To the bit, with a third of the rows in one group, far and odd values, and no job while planning."""
    value = F.expr(
        "CASE id % 50 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN -1e300"
        " WHEN 3 THEN 1e-300 WHEN 4 THEN -0.0 ELSE (xxhash64(id) % 100003) / 1e4 END"
    )
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40)
    df = spark.range(30000).select(key.alias("k"), value.alias("v"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    mine = group_percentile(df, ["k"], "v", 0.95)
    assert len(tracker.getJobIdsForGroup()) == before
    want = {r.k: repr(r.p) for r in df.groupBy("k").agg(F.percentile("v", 0.95).alias("p")).collect()}
    assert {r.k: repr(r.percentile) for r in mine.collect()} == want
