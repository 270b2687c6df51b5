"""Rules of the regression and comparison operators."""

import collections
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hitmill import report
from hitmill.functions.normal import erfc
from hitmill.functions.ranks import below
from hitmill.operators import compare, regress
from hitmill.plans.tables import results
from hitmill.sources.results import RESULTS_SCHEMA

EAST, WEST = "2025-03-03T22:00:39+08:00", "2025-03-03T20:00:00+00:00"


def runs(spark, rows):
    """Rows of (query, type, seconds, revision, time)."""
    full = [("b", q, kind, s, "t", rev, time, 8) for q, kind, s, rev, time in rows]
    return spark.createDataFrame(full, RESULTS_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return runs(
        spark,
        [
            ("q0", "query", 0.99, "east", EAST),
            ("q0", "query", 0.49, "west", WEST),
            ("q0", "table_creation", 0.01, "west", WEST),
            ("q1", "query", 2.0, "west", WEST),
            ("q1", "query", 3.0, "west", WEST),
            (None, "query", 1.0, "west", WEST),
        ],
    )


def test_normalize(small):
    got = {(r.query_name, r.execution_time): r.normalized_time for r in regress.normalize(small).collect()}
    assert got == {
        ("q0", 0.99): pytest.approx(2.0),
        ("q0", 0.49): 1.0,
        ("q1", 2.0): 1.0,
        ("q1", 3.0): pytest.approx(3.01 / 2.01),
    }


def test_lowest_normalised_value_is_one_per_query(spark, sf_dir):
    table = regress.normalize(results(spark, sf_dir))
    lowest = table.groupBy("query_name").agg(F.min("normalized_time").alias("m"))
    assert lowest.where("m <> 1.0").isEmpty()


def test_trend_has_one_row_per_revision(spark, sf_dir):
    table = results(spark, sf_dir)
    trend = regress.trend(regress.normalize(table))
    assert trend.count() == regress.overall(table).first().total_revisions


def test_hot_groups_give_the_same_medians(spark, sf_dir):
    table = regress.normalize(results(spark, sf_dir))
    for operator in (regress.trend, regress.per_query):
        split = operator(table).collect()
        keys = [c for c in split[0].asDict() if c not in ("avg_time", "median_time")]
        usual = table.groupBy(*keys).agg(F.percentile("normalized_time", 0.5).alias("median_time")).collect()
        key = lambda r: r.asDict()["git_revision"] + str(r.asDict().get("query_name"))
        for a, b in zip(sorted(usual, key=key), sorted(split, key=key), strict=True):
            assert a.median_time == b.median_time


def test_text_order_and_time_order_differ(small):
    assert regress.most_recent(small).first()[0] == datetime(2025, 3, 3, 20, 0)
    assert regress.most_recent(small, lexicographic=True).first()[0] == EAST
    order = [r.git_revision for r in regress.with_utc(regress.trend(regress.normalize(small))).collect()]
    assert order == ["east", "west"]


def test_overall_of_nothing(small):
    none = regress.overall(small.where("query_type = 'no'")).first()
    assert tuple(none) == (0, 0, 0, None, None)


def test_markers(spark, small):
    labels = spark.createDataFrame([("west", "1.0"), ("gone", "0.9")], "revision string, label string")
    events = spark.createDataFrame([("east", "switch")], "revision string, label string")
    marks = regress.markers(labels, events, regress.revision_times(small))
    got = sorted((r.tag, r.revision, r.text) for r in marks.collect())
    assert got == [("event", "east", "Event: switch"), ("release", "west", "1.0")]
    untagged = marks.withColumn("tag", F.when(F.col("tag") == "event", F.col("tag")))
    assert [r.tag for r in regress.hide_markers(untagged, "release").collect()] == ["event"]
    assert regress.hide_markers(untagged, "event").isEmpty()
    assert regress.markers_since(marks, datetime(2025, 3, 4), 7).isEmpty()
    assert regress.markers_since(marks, datetime(2025, 3, 4), 90).count() == 2


def test_chart_filters(spark, small):
    points = regress.trend_series(regress.trend(regress.normalize(small)))
    assert [r.series for r in points.collect()] == [regress.AVERAGE_SERIES] * 2 + [regress.MEDIAN_SERIES] * 2
    assert points.first().x == "2025-03-03T14:00:39.000000Z"
    none = spark.createDataFrame([], "revision string")
    east = spark.createDataFrame([("east",), ("east",)], "revision string")
    latest = regress.most_recent(small)
    assert {r.revision for r in regress.only_releases_and_latest(points, none, latest).collect()} == {"west"}
    assert regress.only_releases_and_latest(points, east, latest).count() == 4
    assert {r.revision for r in regress.exclude_releases(points, east).collect()} == {"west"}
    for filtered in (regress.only_releases_and_latest(points, east, latest), regress.exclude_releases(points, none)):
        shown = [(r.series, r.time) for r in filtered.collect()]
        assert len(shown) == 4 and shown == sorted(shown)
    late = datetime(2025, 3, 10, 15)
    assert {r.revision for r in regress.last_week(points, late).collect()} == {"west"}
    assert regress.last_days(points, datetime(2026, 1, 1), 90).isEmpty()
    kept = regress.last_days(points, datetime(2026, 1, 1), 90, east.distinct())
    assert {r.revision for r in kept.collect()} == {"east"}


def test_latest_means_within_one_second(spark, small):
    latest = regress.most_recent(small)
    times = ["19:59:59", "19:59:59.000001", "20:00:00", "20:00:00.999999", "20:00:01"]
    points = spark.createDataFrame([(t, f"2025-03-03 {t}") for t in times], "revision string, t string")
    points = points.withColumn("time", F.col("t").cast("timestamp_ntz")).drop("t")
    none = spark.createDataFrame([], "revision string")
    got = {r.revision for r in regress.only_releases_and_latest(points, none, latest).collect()}
    assert got == set(times[1:4])


def test_most_recent_release(spark, small):
    labels = spark.createDataFrame(
        [("west", 0), ("east", 1), ("gone", 2)], "revision string, position int"
    )
    times = regress.revision_times(small)
    assert regress.most_recent_release(labels, times).first()[0] == "west"
    assert regress.most_recent_release(labels, pick="last").first()[0] == "gone"


def test_slowest_query_first(spark, small):
    medians = regress.per_query(regress.normalize(small))
    assert [r.query_name for r in regress.rank_queries(medians).collect()] == ["q0", "q1"]
    lines = regress.query_series(medians).collect()
    assert [(r.series, r.revision) for r in lines] == [("q0", "east"), ("q0", "west"), ("q1", "west")]


def test_compare(spark):
    table = runs(
        spark,
        [("a", "query", t, "old", WEST) for t in (1.0, 1.2, 9.0)]
        + [("a", "query", t, "new", WEST) for t in (1.2, 1.26)]
        + [("b", "query", 2.0, "old", WEST), ("b", "query", 1.0, "new", WEST)]
        + [("c", "query", 2.0, "old", WEST), ("c", "query", 3.0, "new", WEST)]
        + [("d", "query", 2.0, "old", WEST), ("e", "query", 2.0, "new", WEST)]
        + [("f", "query", 0.0, "old", WEST), ("f", "query", 0.0, "new", WEST)]
        + [("a", "table_creation", 0.0, "new", WEST)],
    )
    got = {r.query_name: (r.ratio, r.verdict) for r in compare.compare_two(table, "old", "new").collect()}
    assert got["a"] == (pytest.approx(1.23 / 1.2), "same")
    assert got["b"] == (0.5, "faster") and got["c"] == (1.5, "slower")
    assert got["d"] == (None, "missing in candidate") and got["e"] == (None, "missing in base")
    assert got["f"] == (None, "same")
    wide = compare.compare_many(table, ["old", "new", "none"]).orderBy("query_name").collect()
    assert tuple(wide[1]) == ("b", 2.0, 1.0, None)
    assert compare.select_benchmarks(table, "^[ab]$", ["b"]).select("query_name").distinct().count() == 2
    assert compare.select_benchmarks(table, suites=["other"]).isEmpty()


def test_report_periods(spark, small):
    releases = spark.createDataFrame(
        [("east", "1.0", 0), ("gone", "2.0", 1)], "revision string, label string, position int"
    )
    events = spark.createDataFrame([("west", "switch")], "revision string, label string")
    tables = report.Report(small, releases, events)

    def shown(period, as_of, **options):
        points = report.chart_points(tables, "performance", period, as_of)
        marks = report.chart_markers(tables, period, as_of, **options)
        return {r.revision for r in points.collect()}, {r.tag for r in marks.collect()}

    late = datetime(2025, 3, 10, 15)
    both, tags = {"east", "west"}, {"release", "event"}
    assert shown("all", late) == (both, tags)
    assert shown("releases_vs_main", late) == (both, tags)
    assert shown("last_week", late) == ({"west"}, set())
    assert shown("last_3_months", late) == (both, tags)
    assert shown("last_6_months", datetime(2026, 1, 1)) == ({"east"}, set())
    assert shown("all", late, show_releases=False) == (both, {"event"})
    assert shown("all", late, show_events=False) == (both, {"release"})
    assert shown("all", late, show_releases=False, show_events=False) == (both, set())
    assert [r.query_name for r in tables.ranking.collect()] == ["q0", "q1"]
    assert tables.queries.count() == 3
    assert tables.overall.first().total_measurements == 5


def brute_test(a, b):
    """The rank-sum test over all pairs, with the standard library's erfc."""
    u = sum(1.0 if x < y else 0.5 if x == y else 0.0 for x in a for y in b)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    ties = sum(c**3 - c for c in collections.Counter(a + b).values())
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    off = u - n1 * n2 / 2
    z = math.copysign(max(abs(off) - 0.5, 0), off) / sigma if sigma else 0.0
    return u, z, min(math.erfc(abs(z) / math.sqrt(2)), 1.0)


def test_significance_equals_all_pairs(spark):
    rng = random.Random(3)
    times = {
        "slow": ([rng.gauss(10, 1) for _ in range(40)], [rng.gauss(12, 1) for _ in range(35)]),
        "fast": ([rng.gauss(10, 1) for _ in range(40)], [rng.gauss(8, 1) for _ in range(35)]),
        "noisy": ([rng.gauss(10, 3) for _ in range(5)], [rng.gauss(10.5, 3) for _ in range(5)]),
        "ties": ([float(rng.randrange(1, 5)) for _ in range(60)], [float(rng.randrange(1, 6)) for _ in range(60)]),
        "equal": ([2.0] * 9, [2.0] * 7),
        "single": ([1.0], [3.0]),
        "zero": ([0.0, 0.0, 1.0], [0.0, 2.0, 2.0]),
        "only base": ([1.0, 2.0], []),
        "only candidate": ([], [1.0]),
    }
    rows = [("b", q, "query", t, "t", r, "t", 1) for q, sides in times.items() for r, ts in zip("xy", sides) for t in ts]
    rows += [("b", "slow", "query", None, "t", "x", "t", 1), ("b", "slow", "table_creation", 99.0, "t", "x", "t", 1), ("b", "slow", "query", 1.0, "t", "z", "t", 1)]
    got = {r.query_name: r for r in compare.significance(spark.createDataFrame(rows, RESULTS_SCHEMA).repartition(4), "x", "y").collect()}
    assert set(got) == set(times)
    for query, (a, b) in times.items():
        r = got[query]
        assert (r.base_runs, r.candidate_runs) == (len(a), len(b))
        if not a or not b:
            assert r.verdict == ("missing in candidate" if a else "missing in base") and r.p_value is None
            continue
        u, z, p = brute_test(a, b)
        assert r.u == u and r.z == pytest.approx(z, abs=1e-12) and r.p_value == pytest.approx(p, rel=3e-7)
        assert r.verdict == ("same" if p >= 0.05 else "slower" if z > 0 else "faster")
    assert [got[q].verdict for q in ("slow", "fast", "equal", "single")] == ["slower", "faster", "same", "same"]
    assert got["single"].detectable_ratio is None and got["equal"].detectable_ratio == 1.0
    assert 1 < got["slow"].detectable_ratio < 1.2 < got["noisy"].detectable_ratio
    assert compare.significance(spark.createDataFrame([], RESULTS_SCHEMA), "x", "y").count() == 0


def test_detectable_ratio_is_detected(spark):
    """Of runs slower by the stated ratio, about the stated share is told apart."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        rows += [("b", f"q{i}", "query", math.exp(rng.gauss(0, 0.1)), "t", "x", "t", 1) for _ in range(30)]
        rows += [("b", f"q{i}", "query", 1.0789 * math.exp(rng.gauss(0, 0.1)), "t", "y", "t", 1) for _ in range(30)]
    out = compare.significance(spark.createDataFrame(rows, RESULTS_SCHEMA), "x", "y").collect()
    assert sum(r.detectable_ratio for r in out) / 300 == pytest.approx(1.0789, abs=0.004)
    assert 0.7 < sum(r.verdict == "slower" for r in out) / 300 < 0.9


def test_significance_spreads_a_hot_query(spark):
    """The runs of one query are ranked by more than one task."""
    rows = spark.range(40_000).select(
        F.lit("b").alias("benchmark_name"), F.lit("hot").alias("query_name"), F.lit("query").alias("query_type"),
        (1 + F.rand(5)).alias("execution_time"), F.lit("t").alias("run_timestamp"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("git_revision"), F.lit("t").alias("git_revision_timestamp"), F.lit(1).alias("num_cores"),
    )
    counts = rows.groupBy("query_name", "execution_time").agg(F.count("*").alias("n"))
    placed = below(counts, ["query_name"], "execution_time", "n", "smaller").withColumn("task", F.spark_partition_id())
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    try:
        sizes = [r["count"] for r in placed.groupBy("task").count().collect()]
    finally:
        spark.conf.unset(small)
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    assert placed.agg(F.max("smaller")).first()[0] == 39_999


def test_erfc_is_close(spark):
    xs = [i / 50 for i in range(400)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1.5e-7) for r in got)
