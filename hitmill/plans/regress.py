"""Regression analytics on the derived results table, with oracle SQL."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.functions.normal import ERFC, quantile
from hitmill.operators import compare, regress
from hitmill.plans.shape import result
from hitmill.plans.tables import over_results, results, table
from hitmill.report import Report, chart_markers, chart_points
from hitmill.sources.labels import last_labels, parse_labels
from hitmill.staging import stage

AS_OF = datetime(2025, 6, 10)
WEEK_AS_OF = datetime(2025, 3, 20)
DAYS = 90
REVISIONS = ["r1", "r2", "r3", "r99"]
# Times have seven decimals, so means of two have no rounding ties at ten places.
PLACES = 10
# The test's figures go through exp and sqrt, which engines round differently.
SHARE_PLACES = 8
# Labels per document of the derived label lists.
PER_DOCUMENT = 1000

# --- label lists ------------------------------------------------------------
# Releases come from suppliers, events from nations: several labels per revision,
# and revisions that the results do not have.


def release_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of release labels, PER_DOCUMENT suppliers each."""
    item = F.struct(
        F.col("s_suppkey").alias("k"),
        F.concat(F.lit("r"), (F.col("s_suppkey") % 10 * 3).cast("string")).alias("revision"),
        F.col("s_name").alias("label"),
    )
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.format_string("%010d", F.floor(F.col("s_suppkey") / PER_DOCUMENT)).alias("document"))
        .agg(F.to_json(F.sort_array(F.collect_list(item))).alias("text"))
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_labels(parse_labels(release_documents(spark, sf_dir)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("r"), (F.col("n_nationkey") * 7 % 40).cast("string")).alias("revision"),
        F.col("n_name").alias("label"),
    )


RELEASES_CTE = (
    "releases AS (SELECT revision, arg_max(label, k) AS label, max(k) AS k FROM"
    " (SELECT 'r' || CAST(s_suppkey % 10 * 3 AS VARCHAR) AS revision, s_name AS label,"
    " s_suppkey AS k FROM supplier) GROUP BY revision)"
)
EVENTS_CTE = (
    "marked AS (SELECT 'r' || CAST(n_nationkey * 7 % 40 AS VARCHAR) AS revision,"
    " n_name AS label FROM nation)"
)

# --- shared steps -----------------------------------------------------------


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised rows; the staged baseline lets Spark see how small it is."""
    runs = results(spark, sf_dir)
    return regress.normalize(runs, stage(regress.baseline(runs), "baseline"))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged: a sort samples its input, which would compute all medians twice."""
    return stage(regress.trend(normalized(spark, sf_dir)), "trend")


def per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(regress.per_query(normalized(spark, sf_dir)), "per-query")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regress.trend_series(trend(spark, sf_dir))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regress.revision_times(results(spark, sf_dir))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regress.markers(releases(spark, sf_dir), events(spark, sf_dir), times(spark, sf_dir))


_UTC = "CAST(git_revision_timestamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"
_BASE = (
    "base AS (SELECT query_name, min(execution_time) AS baseline_time FROM benchmark_results"
    " WHERE query_type = 'query' GROUP BY query_name)"
)
_NORMAL = (
    "normal AS (SELECT r.git_revision, r.git_revision_timestamp, r.query_name, r.execution_time,"
    " b.baseline_time, (0.01 + r.execution_time) / (0.01 + b.baseline_time) AS normalized_time"
    " FROM benchmark_results r JOIN base b ON r.query_name = b.query_name"
    " WHERE r.query_type = 'query')"
)
_TREND = (
    "trend AS (SELECT git_revision, git_revision_timestamp, avg(normalized_time) AS avg_time,"
    " median(normalized_time) AS median_time FROM normal"
    " GROUP BY git_revision, git_revision_timestamp)"
)
_PER_QUERY = (
    "medians AS (SELECT git_revision, git_revision_timestamp, query_name,"
    " median(normalized_time) AS median_time FROM normal"
    " GROUP BY git_revision, git_revision_timestamp, query_name)"
)
_POINTS = (
    f"points AS (SELECT 'Average Normalized Time' AS series, {_UTC} AS time, avg_time AS y,"
    " git_revision AS revision FROM trend"
    f" UNION ALL SELECT 'Median Normalized Time', {_UTC}, median_time, git_revision FROM trend)"
)
_TIMES = (
    f"times AS (SELECT git_revision, min({_UTC}) AS revision_time FROM benchmark_results"
    " WHERE query_type = 'query' GROUP BY git_revision)"
)
_MARKS = (
    "marks AS (SELECT 'release' AS tag, l.revision, l.label AS text, t.revision_time"
    " FROM releases l JOIN times t ON l.revision = t.git_revision"
    " UNION ALL SELECT 'event', l.revision, 'Event: ' || l.label, t.revision_time"
    " FROM marked l JOIN times t ON l.revision = t.git_revision)"
)
_NEWEST = (
    "newest AS (SELECT l.revision FROM releases l JOIN times t ON l.revision = t.git_revision"
    " ORDER BY t.revision_time DESC, l.k DESC LIMIT 1)"
)
_X = "strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') AS x"
_POINT = f"SELECT series, time, {_X}, round(y, 6) AS y, revision FROM points"
_CHAIN = (_BASE, _NORMAL, _TREND, _POINTS)
_MARK_CHAIN = (RELEASES_CTE, EVENTS_CTE, _TIMES, _MARKS)


def _reg_row_count(spark, sf_dir):
    return regress.row_count(results(spark, sf_dir))


def _reg_overall(spark, sf_dir):
    return regress.overall(results(spark, sf_dir))


def _reg_overall_text(spark, sf_dir):
    return regress.overall(results(spark, sf_dir), lexicographic=True)


def _reg_baseline(spark, sf_dir):
    return result(regress.baseline(results(spark, sf_dir)), None)


def _reg_normalize(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    return rows.withColumn("normalized_time", F.round("normalized_time", 6))


def _reg_trend(spark, sf_dir):
    return result(regress.by_text_time(trend(spark, sf_dir)))


def _reg_per_query(spark, sf_dir):
    return result(regress.by_text_time(per_query(spark, sf_dir)))


def _reg_to_utc(spark, sf_dir):
    return result(regress.with_utc(trend(spark, sf_dir)))


def _reg_most_recent(spark, sf_dir):
    return regress.most_recent(results(spark, sf_dir))


def _reg_most_recent_text(spark, sf_dir):
    return regress.most_recent(results(spark, sf_dir), lexicographic=True)


def _reg_rev_time(spark, sf_dir):
    return times(spark, sf_dir)


def _reg_markers(spark, sf_dir):
    return marks(spark, sf_dir)


def _reg_rank_queries(spark, sf_dir):
    return result(regress.rank_queries(per_query(spark, sf_dir)))


def _reg_series(spark, sf_dir):
    return result(points(spark, sf_dir))


def _reg_query_series(spark, sf_dir):
    return result(regress.query_series(per_query(spark, sf_dir)))


def _reg_filter_releases_vs_main(spark, sf_dir):
    latest = regress.most_recent(results(spark, sf_dir))
    return result(
        regress.only_releases_and_latest(points(spark, sf_dir), releases(spark, sf_dir), latest)
    )


def _reg_filter_last_week(spark, sf_dir):
    return result(regress.last_week(points(spark, sf_dir), WEEK_AS_OF))


def _reg_filter_last_n(spark, sf_dir):
    newest = regress.most_recent_release(releases(spark, sf_dir), times(spark, sf_dir))
    return result(regress.last_days(points(spark, sf_dir), AS_OF, DAYS, newest))


def _reg_markers_since(spark, sf_dir):
    return regress.markers_since(marks(spark, sf_dir), AS_OF, DAYS)


def _reg_exclude_releases(spark, sf_dir):
    return result(regress.exclude_releases(points(spark, sf_dir), releases(spark, sf_dir)))


def _reg_marker_toggle(spark, sf_dir):
    return regress.hide_markers(marks(spark, sf_dir), "release")


def _reg_most_recent_release(spark, sf_dir):
    return regress.most_recent_release(releases(spark, sf_dir), times(spark, sf_dir))


def _reg_most_recent_release_last(spark, sf_dir):
    return regress.most_recent_release(releases(spark, sf_dir), pick="last")


def _report(spark: SparkSession, sf_dir: str) -> Report:
    return Report(results(spark, sf_dir), releases(spark, sf_dir), events(spark, sf_dir))


def _reg_report_points(spark, sf_dir):
    return result(chart_points(_report(spark, sf_dir), "queries", "last_3_months", AS_OF))


def _reg_report_markers(spark, sf_dir):
    return chart_markers(_report(spark, sf_dir), "last_3_months", AS_OF, show_events=False)


def _cmp_two(spark, sf_dir):
    return result(compare.compare_two(results(spark, sf_dir), "r1", "r2"), PLACES)


def _cmp_many(spark, sf_dir):
    return result(compare.compare_many(results(spark, sf_dir), REVISIONS), PLACES)


def _cmp_filter(spark, sf_dir):
    chosen = compare.select_benchmarks(
        results(spark, sf_dir), "^q[1-3]$", ["clickbench_partitioned", "tpch_mem"]
    )
    return result(compare.compare_two(chosen, "r1", "r2"), PLACES)


def _cmp_significance(spark, sf_dir):
    return result(compare.significance(results(spark, sf_dir), "r1", "r2"), SHARE_PLACES)


_SIDES = (
    "sides AS (SELECT query_name, median(execution_time) FILTER (git_revision = 'r1') AS base_time,"
    " median(execution_time) FILTER (git_revision = 'r2') AS candidate_time"
    " FROM benchmark_results WHERE query_type = 'query' AND git_revision IN ('r1', 'r2')"
    " GROUP BY query_name)"
)
_TWO = (
    f"SELECT query_name, round(base_time, {PLACES}) AS base_time,"
    f" round(candidate_time, {PLACES}) AS candidate_time,"
    f" round(candidate_time / base_time, {PLACES}) AS ratio,"
    " CASE WHEN base_time IS NULL THEN 'missing in base'"
    " WHEN candidate_time IS NULL THEN 'missing in candidate'"
    " WHEN candidate_time / base_time < 0.95 THEN 'faster'"
    " WHEN candidate_time / base_time > 1.05 THEN 'slower' ELSE 'same' END AS verdict FROM sides"
)
# All pairs of runs, one by one.
_TESTED = (
    "runs AS (SELECT query_name, execution_time AS t, git_revision = 'r1' AS base"
    " FROM benchmark_results WHERE query_type = 'query' AND git_revision IN ('r1', 'r2')),\n"
    "pairs AS (SELECT x.query_name, sum(CASE WHEN x.t < y.t THEN 1.0 WHEN x.t = y.t THEN 0.5 ELSE 0.0 END)"
    " AS u FROM runs x JOIN runs y ON x.query_name = y.query_name AND x.base AND NOT y.base GROUP BY 1),\n"
    "tied AS (SELECT query_name, sum(c * c * c - c) AS ties FROM (SELECT query_name, t,"
    " CAST(count(*) AS DOUBLE) AS c FROM runs GROUP BY 1, 2) GROUP BY 1),\n"
    "sized AS (SELECT query_name, count(*) FILTER (base) AS n1, count(*) FILTER (NOT base) AS n2,"
    " var_samp(ln(t)) FILTER (base) AS v1, var_samp(ln(t)) FILTER (NOT base) AS v2 FROM runs GROUP BY 1),\n"
    "scored AS (SELECT *, CASE WHEN sd > 0 THEN sign(u - n1 * n2 / 2.0)"
    " * greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sd ELSE 0 END AS z FROM (SELECT *,"
    " sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd"
    " FROM sized LEFT JOIN pairs USING (query_name) JOIN tied USING (query_name))),\n"
    "tested AS (SELECT *, least(k * exp(" + " + k * (".join(str(c) for c in ERFC) + ")" * (len(ERFC) - 1) + " - x * x), 1.0) AS p"
    " FROM (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + abs(z) / sqrt(2) / 2) AS k FROM scored))"
)
_REACH = (quantile(1 - compare.ALPHA / 2) + quantile(compare.POWER)) * math.sqrt(math.pi / 3)
_SIGNIFICANCE = (
    "SELECT query_name, n1 AS base_runs, n2 AS candidate_runs,"
    f" round(CAST(u AS DOUBLE), {SHARE_PLACES}) AS u, round(u / (n1 * n2), {SHARE_PLACES}) AS slower_share,"
    f" CASE WHEN n1 > 0 AND n2 > 0 THEN round(z, {SHARE_PLACES}) END AS z,"
    f" CASE WHEN n1 > 0 AND n2 > 0 THEN round(p, {SHARE_PLACES}) END AS p_value,"
    f" round(exp({_REACH!r} * sqrt(v1 / n1 + v2 / n2)), {SHARE_PLACES}) AS detectable_ratio,"
    " CASE WHEN n1 = 0 THEN 'missing in base' WHEN n2 = 0 THEN 'missing in candidate'"
    " WHEN p >= 0.05 THEN 'same' WHEN z > 0 THEN 'slower' ELSE 'faster' END AS verdict FROM tested"
)
_MEDIANS_OF = ", ".join(
    f"round(median(execution_time) FILTER (git_revision = '{r}'), {PLACES}) AS {r}" for r in REVISIONS
)

_SQL = {
    "reg_row_count": over_results("SELECT count(*) AS row_count FROM benchmark_results"),
    "reg_overall": over_results(
        "SELECT count(DISTINCT git_revision) AS total_revisions,"
        " count(DISTINCT query_name) AS total_queries, count(*) AS total_measurements,"
        f" min({_UTC}) AS earliest_revision, max({_UTC}) AS latest_revision"
        " FROM benchmark_results WHERE query_type = 'query'"
    ),
    "reg_overall_text": over_results(
        "SELECT count(DISTINCT git_revision) AS total_revisions,"
        " count(DISTINCT query_name) AS total_queries, count(*) AS total_measurements,"
        " min(git_revision_timestamp) AS earliest_revision,"
        " max(git_revision_timestamp) AS latest_revision"
        " FROM benchmark_results WHERE query_type = 'query'"
    ),
    "reg_baseline": over_results(
        "SELECT query_name, baseline_time FROM base", _BASE
    ),
    "reg_normalize": over_results(
        "SELECT git_revision, git_revision_timestamp, query_name,"
        " execution_time, baseline_time, round(normalized_time, 6) AS normalized_time FROM normal",
        _BASE,
        _NORMAL,
    ),
    "reg_trend": over_results(
        "SELECT git_revision, git_revision_timestamp, round(avg_time, 6) AS avg_time,"
        " round(median_time, 6) AS median_time FROM trend"
        " ORDER BY git_revision_timestamp, git_revision",
        _BASE,
        _NORMAL,
        _TREND,
    ),
    "reg_per_query": over_results(
        "SELECT git_revision, git_revision_timestamp, query_name,"
        " round(median_time, 6) AS median_time FROM medians"
        " ORDER BY git_revision_timestamp, query_name, git_revision",
        _BASE,
        _NORMAL,
        _PER_QUERY,
    ),
    "reg_to_utc": over_results(
        f"SELECT git_revision, {_UTC} AS git_revision_timestamp, round(avg_time, 6) AS avg_time,"
        " round(median_time, 6) AS median_time FROM trend ORDER BY 2, 1",
        _BASE,
        _NORMAL,
        _TREND,
    ),
    "reg_most_recent": over_results(
        f"SELECT max({_UTC}) AS most_recent FROM benchmark_results WHERE query_type = 'query'"
    ),
    "reg_most_recent_text": over_results(
        "SELECT max(git_revision_timestamp) AS most_recent FROM benchmark_results"
        " WHERE query_type = 'query'"
    ),
    "reg_rev_time": over_results("SELECT git_revision, revision_time FROM times", _TIMES),
    "reg_markers": over_results("SELECT * FROM marks", *_MARK_CHAIN),
    "reg_rank_queries": over_results(
        "SELECT query_name, round(avg(median_time), 6) AS mean_median FROM medians"
        " GROUP BY query_name ORDER BY avg(median_time) DESC, query_name",
        _BASE,
        _NORMAL,
        _PER_QUERY,
    ),
    "reg_series": over_results(f"{_POINT} ORDER BY series, time, revision", *_CHAIN),
    "reg_query_series": over_results(
        f"SELECT query_name AS series, {_UTC} AS time,"
        f" strftime({_UTC}, '%Y-%m-%dT%H:%M:%S.%fZ') AS x, round(median_time, 6) AS y,"
        " git_revision AS revision,"
        " round(avg(median_time) OVER (PARTITION BY query_name), 6) AS mean_median FROM medians",
        _BASE,
        _NORMAL,
        _PER_QUERY,
    ),
    "reg_filter_releases_vs_main": over_results(
        f"{_POINT} WHERE revision IN (SELECT revision FROM releases)"
        f" OR abs(epoch(time) - (SELECT epoch(max({_UTC})) FROM benchmark_results"
        " WHERE query_type = 'query')) < 1",
        RELEASES_CTE,
        *_CHAIN,
    ),
    "reg_filter_last_week": over_results(
        f"{_POINT} WHERE time >= TIMESTAMP '{WEEK_AS_OF}' - INTERVAL 7 DAY", *_CHAIN
    ),
    "reg_filter_last_n": over_results(
        f"{_POINT} WHERE time >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"
        " OR revision = (SELECT revision FROM newest)",
        RELEASES_CTE,
        _TIMES,
        _NEWEST,
        *_CHAIN,
    ),
    "reg_markers_since": over_results(
        f"SELECT * FROM marks WHERE revision_time >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY",
        *_MARK_CHAIN,
    ),
    "reg_exclude_releases": over_results(
        f"{_POINT} WHERE revision NOT IN (SELECT revision FROM releases)", RELEASES_CTE, *_CHAIN
    ),
    "reg_marker_toggle": over_results("SELECT * FROM marks WHERE tag <> 'release'", *_MARK_CHAIN),
    "reg_most_recent_release": over_results(
        "SELECT revision FROM newest", RELEASES_CTE, _TIMES, _NEWEST
    ),
    "reg_most_recent_release_last": (
        f"WITH {RELEASES_CTE} SELECT revision FROM releases ORDER BY k DESC LIMIT 1"
    ),
    "reg_report_points": over_results(
        f"SELECT query_name AS series, {_UTC} AS time,"
        f" strftime({_UTC}, '%Y-%m-%dT%H:%M:%S.%fZ') AS x, round(median_time, 6) AS y,"
        " git_revision AS revision, round(mean_median, 6) AS mean_median FROM (SELECT *,"
        " avg(median_time) OVER (PARTITION BY query_name) AS mean_median FROM medians)"
        f" WHERE {_UTC} >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"
        " OR git_revision = (SELECT revision FROM newest)",
        RELEASES_CTE,
        _TIMES,
        _NEWEST,
        _BASE,
        _NORMAL,
        _PER_QUERY,
    ),
    "reg_report_markers": over_results(
        f"SELECT * FROM marks WHERE revision_time >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"
        " AND tag <> 'event'",
        *_MARK_CHAIN,
    ),
    "cmp_two": over_results(_TWO, _SIDES),
    "cmp_many": over_results(
        f"SELECT query_name, {_MEDIANS_OF} FROM benchmark_results WHERE query_type = 'query'"
        f" AND git_revision IN ({', '.join(repr(r) for r in REVISIONS)}) GROUP BY query_name"
    ),
    "cmp_significance": over_results(_SIGNIFICANCE, _TESTED),
    "cmp_filter": over_results(_TWO + " WHERE query_name IN ('q1', 'q2', 'q3')", _SIDES),
}


def queries():
    return {name: globals()[f"_{name}"] for name in _SQL}


def oracle_sql():
    return dict(_SQL)
