"""Timings kept as signed counts."""

import pytest
from pyspark.sql import functions as F

from hitmill.functions.quantiles import group_percentile
from hitmill.operators import histograms, regress
from hitmill.plans.tables import results


def close(one, two, keys, places=9):
    shape = lambda df: sorted(tuple(round(x, places) if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))) for r in df.collect())
    assert shape(one) == shape(two)


def test_appends_and_removals_equal_computing_anew(spark, sf_dir):
    runs = results(spark, sf_dir)
    part = F.pmod(F.xxhash64("execution_time", "git_revision"), F.lit(3))
    counts = histograms.value_counts(runs.where(part == 0))
    counts = histograms.merged(counts, histograms.value_counts(runs.where(part == 1)))
    gone = runs.where((part == 1) & (F.col("query_name") == "q2"))
    counts = histograms.merged(counts, histograms.value_counts(gone, -1))
    # The fastest time of a query goes, so its baseline rises.
    best = runs.where(part != 2).exceptAll(gone).where("query_type = 'query'").orderBy("execution_time").limit(1)
    counts = histograms.merged(counts, histograms.value_counts(best, -1))
    left = runs.where(part != 2).exceptAll(gone).exceptAll(best)
    normalized, anew = histograms.normalize(counts), regress.normalize(left)
    close(histograms.baseline(counts), regress.baseline(left), ["query_name"])
    close(histograms.trend(normalized), regress.trend(anew), ["git_revision"])
    close(histograms.per_query(normalized), regress.per_query(anew), ["git_revision", "query_name"])


def test_what_cancels_out_is_gone_and_too_much_fails(spark, sf_dir):
    runs = results(spark, sf_dir)
    counts = histograms.value_counts(runs)
    assert histograms.merged(counts, histograms.value_counts(runs, -1)).isEmpty()
    with pytest.raises(Exception, match="more runs were removed"):
        histograms.merged(histograms.value_counts(runs, -1)).select("n").collect()


def test_weights_stand_for_equal_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.xxhash64("id") % 101 / 7).alias("v"))
    counts = rows.groupBy("k", "v").agg(F.count("*").alias("n"))
    for fraction in (0.0, 0.25, 0.5, 0.95, 1.0):
        one = {r.k: r.p for r in group_percentile(rows, ["k"], "v", fraction, name="p").collect()}
        two = {r.k: r.p for r in group_percentile(counts, ["k"], "v", fraction, name="p", weight="n").collect()}
        assert one == two
