"""Summaries of days that merge, and frequent values from sketches."""

import re

import pytest
from pyspark.sql import functions as F
from test_plans import plan

from hitmill.operators import daily, heavy
from hitmill.staging import stage


def days(spark, n=20_000):
    """A third of all rows in one group; values with ties and nulls."""
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50)
    value = F.when(F.col("id") % 11 == 0, None).otherwise((F.xxhash64("id") % 5003 + F.xxhash64("id") % 11).cast("int"))
    return spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("EventDate"),
        key.alias("ClientIP"), F.lit(1).alias("WatchID"), value.alias("ResponseStartTiming"),
        F.concat(F.lit("u"), F.xxhash64("id") % 997).alias("UserID"),
    )


@pytest.mark.parametrize("fraction", [0.5, 0.95])
def test_rank_error_of_merged_sketches(spark, fraction):
    rows = days(spark)
    sketches = stage(daily.tail_sketches(rows), "sketches")
    assert sketches.count() == rows.select("EventDate", "ClientIP").distinct().count()
    got = {r.ClientIP: r for r in daily.merged_tail(sketches, fraction, k=100).collect()}
    assert len(got) == rows.select("ClientIP").distinct().count()
    for key, r in got.items():
        values = sorted(x[0] for x in rows.where((F.col("ClientIP") == key) & F.col("ResponseStartTiming").isNotNull()).select("ResponseStartTiming").collect()) if key in (-1, 1, 2) else None
        if values:
            low = sum(v < r.tp95 for v in values) / len(values)
            high = sum(v <= r.tp95 for v in values) / len(values)
            # The published error of sketches of this size, two-sided.
            assert low - 0.0165 <= fraction <= high + 0.0165
            assert (r.tmin, r.tmax) == (values[0], values[-1])


def test_a_new_day_adds_a_sketch(spark):
    rows = days(spark, 900)
    old, new = (rows.where(c) for c in (F.col("EventDate") < "2024-01-07", F.col("EventDate") == "2024-01-07"))
    sketch = lambda df: daily.tail_sketches(df, size=1000)
    both = sketch(old).unionByName(sketch(new))
    assert sorted(map(tuple, daily.merged_tail(both, k=99).collect())) == sorted(map(tuple, daily.merged_tail(sketch(rows), k=99).collect()))
    none = rows.withColumn("ResponseStartTiming", F.lit(None).cast("int"))
    assert {r.tp95 for r in daily.merged_tail(daily.tail_sketches(none)).collect()} == {None}
    assert daily.merged_tail(daily.tail_sketches(rows.limit(0))).count() == 0


def test_numbers_are_dense_and_stay(spark):
    rows = days(spark).repartition(7)
    first = stage(daily.number_values(rows.select(F.col("UserID").alias("value"))), "numbers")
    users = rows.select("UserID").distinct().count()
    assert sorted(r.id for r in first.collect()) == list(range(users))
    more = spark.createDataFrame([("new1",), ("new2",), ("new1",), ("u1",), (None,)], "value string")
    second = daily.number_values(more, first).collect()
    assert sorted(r.id for r in second) == [users, users + 1] and {r.value for r in second} == {"new1", "new2"}
    empty = daily.number_values(more.limit(0), first)
    assert empty.count() == 0 and daily.number_values(more, empty.limit(0)).count() == 3


def test_bitmaps_count_distinct_values(spark):
    rows = days(spark)
    ids = stage(daily.number_values(rows.select(F.col("UserID").alias("value"))), "numbers")
    bitmaps = stage(daily.daily_bitmaps(rows, ids, "UserID", ["ClientIP"]), "bitmaps")
    want = {r.ClientIP: r.u for r in rows.groupBy("ClientIP").agg(F.count_distinct("UserID").alias("u")).collect()}
    assert {r.ClientIP: r.u for r in daily.distinct_counts(bitmaps, ["ClientIP"]).collect()} == want
    assert daily.distinct_counts(daily.daily_bitmaps(rows, ids, "UserID")).first().u == rows.select("UserID").distinct().count()
    assert daily.distinct_counts(bitmaps.limit(0)).first().u == 0


def test_a_new_day_reads_itself_only(spark, tmp_path):
    rows = days(spark, 2000)
    path = str(tmp_path / "hits")
    rows.write.partitionBy("EventDate").parquet(path)
    table = spark.read.parquet(path)
    ids = stage(daily.number_values(table.select(F.col("UserID").alias("value"))), "numbers")
    text = plan(daily.daily_bitmaps(table.where(F.col("EventDate") == "2024-01-03"), ids, "UserID"))
    assert re.search(r"PartitionFilters: \[.*EventDate", text)


def counted(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("tracked, most", [(16, 16), (16, 1024), (4096, 4096)])
def test_heavy_hitters_are_exact(spark, tracked, most):
    """Proven by a small sketch, by a grown one, by a complete one, or by counting all."""
    skewed = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm").otherwise(F.concat(F.lit("k"), F.xxhash64("id") % 700))
    rows = spark.range(9000).select(skewed.alias("a"), (F.col("id") % 4).alias("b"))
    for keys, k in ((["a"], 2), (["a"], 10), (["a", "b"], 7), (["b"], 10)):
        want = rows.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(k)
        assert counted(heavy.top_counts(rows, keys, k, tracked=tracked, most=most)) == counted(want)


def test_heavy_hitters_without_rows_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "b", "a", None]], "a string")
    assert counted(heavy.top_counts(rows, ["a"], 3)) == [("a", 2), ("b", 2), (None, 2)]
    assert counted(heavy.top_counts(rows, ["a"], 3, where=F.col("a") > "z")) == []


def test_only_candidates_are_shuffled(spark):
    """Rows that cross the exchange: the candidates' partial counts."""
    hot = F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(F.col("id") + 100)
    rows = spark.range(60_000).select(hot.alias("a"))
    best = heavy.top_counts(rows, ["a"], 5, tracked=64)
    best.collect()
    written, todo = [], [best._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert written and max(written) < 2000
