"""Sources, sinks, ingestion and commit history on derived tables, with oracle SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.ingestion import append_new_revisions, stored_results
from hitmill.operators import history, ingest
from hitmill.plans import regress
from hitmill.plans.shape import result
from hitmill.plans.tables import (
    commits,
    derived,
    derived_cte,
    over_commits,
    over_results,
    results,
    table,
)
from hitmill.sources.commits import load_adhoc_csv
from hitmill.sources.hits import load_hits
from hitmill.sources.labels import last_labels, load_labels
from hitmill.sources.logs import load_logs
from hitmill.sources.results import RESULTS_COLUMNS, append_results, load_results
from hitmill.staging import new_path

AS_OF = date(1996, 1, 1)
DAYS = 30
PREFIX = "engine-cli"

# --- derived inputs ---------------------------------------------------------
# SQL that both engines read alike.

_LINES = (
    "SELECT 'q' || CAST(event_id % 43 AS STRING) AS log, event_id AS line_no,"
    " CASE event_id % 7 WHEN 0 THEN 'Elapsed abc seconds.' WHEN 1 THEN 'Elapsed'"
    " WHEN 2 THEN '| 1 row |'"
    " ELSE 'Elapsed ' || CAST(value AS STRING) || ' seconds.' END AS line FROM {events}"
)
_NAMES = (
    "SELECT CASE o_orderkey % 4"
    " WHEN 0 THEN 'engine-cli@c' || CAST(o_orderkey AS STRING) || '@2025-01-01T00:00:00+00:00'"
    " WHEN 1 THEN 'engine-cli@c' || CAST(o_orderkey AS STRING)"
    " WHEN 2 THEN 'engine-cli'"
    " ELSE 'other@c' || CAST(o_orderkey AS STRING) || '@now' END AS name FROM {orders}"
)
_STORED = "SELECT DISTINCT 'r' || CAST(s_suppkey % 7 AS STRING) AS git_revision FROM {supplier}"
_LISTED = (
    "SELECT DISTINCT 'q' || CAST(l_linenumber + 1 AS STRING) AS query_name FROM {lineitem}"
)
_OUTCOMES = "SELECT o_orderkey AS build, o_orderstatus <> 'P' AS ok FROM {orders}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "lines", _LINES, "events")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "names", _NAMES, "orders")


_LINES_CTE = derived_cte("lines", _LINES, "events")
_NAMES_CTE = derived_cte("names", _NAMES, "orders")
_TIMINGS = (
    "timings AS (SELECT log, line_no, TRY_CAST(string_split(line, ' ')[2] AS DOUBLE)"
    " AS execution_time FROM lines WHERE contains(line, 'Elapsed')"
    " AND len(string_split(line, ' ')) >= 3"
    " AND TRY_CAST(string_split(line, ' ')[2] AS DOUBLE) IS NOT NULL)"
)

# --- sources and sinks ------------------------------------------------------


def _src_parquet_dir(spark, sf_dir):
    """A hits directory with binary text and day numbers, read as text and dates."""
    path = new_path(spark, "binary-hits")
    events = table(spark, sf_dir, "events")
    events.select(
        F.unix_date(F.to_date("ts")).alias("EventDate"),
        F.col("user_id").alias("UserID"),
        F.col("event_type").cast("binary").alias("SearchPhrase"),
        (F.col("user_id") % 5).cast("int").alias("RegionID"),
    ).write.partitionBy("RegionID").parquet(path)
    return (
        load_hits(spark, path)
        .where(F.col("SearchPhrase") != "error")
        .groupBy("RegionID", "EventDate", "SearchPhrase")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("UserID").alias("sum_user"))
    )


def _src_csv_results(spark, sf_dir):
    path = new_path(spark, "results-csv")
    append_results(results(spark, sf_dir), path)
    return load_results(spark, f"{path}/*.csv")


def _src_csv_adhoc(spark, sf_dir):
    path = new_path(spark, "commits-csv")
    commits(spark, sf_dir).write.option("header", True).csv(path)
    return result(load_adhoc_csv(spark, path))


def _src_json_labels(spark, sf_dir):
    path = new_path(spark, "labels")
    regress.release_documents(spark, sf_dir).write.partitionBy("document").text(path)
    return last_labels(load_labels(spark, path)).select("revision", "label")


def _src_timing_logs(spark, sf_dir):
    path = new_path(spark, "logs")
    lines(spark, sf_dir).select("line").write.text(path)
    return ingest.extract_timings(load_logs(spark, path)).select("execution_time")


def _sink_csv_append(spark, sf_dir):
    path = new_path(spark, "results-appended")
    runs = results(spark, sf_dir)
    for kind in ("table_creation", "query"):
        append_results(runs.where(F.col("query_type") == kind), path)
    return (
        load_results(spark, f"{path}/*.csv")
        .groupBy("git_revision", "query_type")
        .agg(F.count(F.lit(1)).alias("c"), F.max("execution_time").alias("slowest"))
    )


# --- ingestion --------------------------------------------------------------


def _ing_timings(spark, sf_dir):
    return ingest.extract_timings(lines(spark, sf_dir))


def _ing_label_runs(spark, sf_dir):
    timings = ingest.extract_timings(lines(spark, sf_dir))
    return ingest.label_runs(
        timings,
        F.col("log"),
        "clickbench_partitioned",
        "2025-06-01 00:00:00",
        "r1",
        "2025-03-03T22:00:00+00:00",
        16,
    )


def _ing_expected_runs(spark, sf_dir):
    listed = derived(spark, sf_dir, "listed", _LISTED, "lineitem")
    return ingest.expected_runs(results(spark, sf_dir), listed, 400)


def _ing_skip_done(spark, sf_dir):
    stored = derived(spark, sf_dir, "stored", _STORED, "supplier")
    return ingest.new_revisions(results(spark, sf_dir), stored)


def _ing_artifact_names(spark, sf_dir):
    return ingest.parse_artifacts(names(spark, sf_dir))


def _ing_artifact_glob(spark, sf_dir):
    return ingest.select_artifacts(names(spark, sf_dir), f"{PREFIX}@*")


def _ing_missing_builds(spark, sf_dir):
    return result(
        ingest.missing_builds(commits(spark, sf_dir), names(spark, sf_dir), AS_OF, DAYS, PREFIX)
    )


def _ing_commit_window(spark, sf_dir):
    return result(ingest.commit_window(commits(spark, sf_dir), AS_OF, DAYS))


def _ing_build_summary(spark, sf_dir):
    return ingest.build_summary(derived(spark, sf_dir, "outcomes", _OUTCOMES, "orders"))


def _ing_append_once(spark, sf_dir):
    """Two overlapping batches and a repeat leave every row once."""
    path = new_path(spark, "results-once")
    runs = results(spark, sf_dir)
    early = runs.where(F.col("git_revision_timestamp") < "2025-03-10")
    for batch in (early, runs, runs):
        append_new_revisions(batch, path, "parquet")
    return stored_results(spark, path, "parquet")


# --- history ----------------------------------------------------------------


def _hist_day_bucket(spark, sf_dir):
    return result(history.with_bucket(commits(spark, sf_dir)))


def _hist_daily_pick(spark, sf_dir):
    return result(history.daily_pick(commits(spark, sf_dir)))


def _hist_daily_pick_repeats(spark, sf_dir):
    """Revisions shortened to a digit, so that several commits of a day share one."""
    short = commits(spark, sf_dir).withColumn(
        "revision", F.concat(F.lit("c"), F.substring("revision", -1, 1))
    )
    return result(history.daily_pick(short, keep_repeats=True))


def _hist_command_rows(spark, sf_dir):
    picks = history.daily_pick(commits(spark, sf_dir))
    return history.command_rows(picks, "./build.sh")


_SINCE = f"DATE '{AS_OF}' - INTERVAL {DAYS} DAY"
_PICKS = (
    "picks AS (SELECT revision, date_trunc('day', time) AS day, time, url,"
    " row_number() OVER (PARTITION BY date_trunc('day', time)"
    " ORDER BY time DESC, revision DESC, url DESC) AS rn FROM commits)"
)
_COLUMNS = ", ".join(RESULTS_COLUMNS)

_SQL = {
    "src_parquet_dir": (
        "SELECT CAST(user_id % 5 AS INTEGER) AS RegionID, CAST(ts AS DATE) AS EventDate,"
        " event_type AS SearchPhrase, count(*) AS c, CAST(sum(user_id) AS BIGINT) AS sum_user"
        " FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3"
    ),
    "src_csv_results": over_results(f"SELECT {_COLUMNS} FROM benchmark_results"),
    "src_csv_adhoc": over_commits("SELECT revision, time, url FROM commits"),
    "src_json_labels": f"WITH {regress.RELEASES_CTE} SELECT revision, label FROM releases",
    "src_timing_logs": f"WITH {_LINES_CTE}, {_TIMINGS} SELECT execution_time FROM timings",
    "sink_csv_append": over_results(
        "SELECT git_revision, query_type, count(*) AS c, max(execution_time) AS slowest"
        " FROM benchmark_results GROUP BY git_revision, query_type"
    ),
    "ing_timings": f"WITH {_LINES_CTE}, {_TIMINGS} SELECT log, line_no, execution_time FROM timings",
    "ing_label_runs": (
        f"WITH {_LINES_CTE}, {_TIMINGS} SELECT 'clickbench_partitioned' AS benchmark_name,"
        " log AS query_name,"
        " CASE WHEN row_number() OVER (PARTITION BY log ORDER BY line_no) = 1"
        " THEN 'table_creation' ELSE 'query' END AS query_type, execution_time,"
        " '2025-06-01 00:00:00' AS run_timestamp, 'r1' AS git_revision,"
        " '2025-03-03T22:00:00+00:00' AS git_revision_timestamp,"
        " CAST(16 AS BIGINT) AS num_cores FROM timings"
    ),
    "ing_expected_runs": over_results(
        "SELECT l.query_name, r.git_revision, coalesce(r.n, 0) AS runs,"
        " coalesce(r.n, 0) = 400 AS complete FROM listed l LEFT JOIN"
        " (SELECT query_name, git_revision, count(*) AS n FROM benchmark_results"
        " WHERE query_type = 'query' GROUP BY query_name, git_revision) r"
        " ON l.query_name = r.query_name",
        derived_cte("listed", _LISTED, "lineitem"),
    ),
    "ing_skip_done": over_results(
        f"SELECT {_COLUMNS} FROM benchmark_results"
        " WHERE git_revision NOT IN (SELECT git_revision FROM stored)",
        derived_cte("stored", _STORED, "supplier"),
    ),
    "ing_append_once": over_results(f"SELECT {_COLUMNS} FROM benchmark_results"),
    "ing_artifact_names": (
        f"WITH {_NAMES_CTE} SELECT name,"
        " CASE WHEN len(string_split(name, '@')) >= 3 THEN split_part(name, '@', 2)"
        " ELSE 'unknown' END AS version,"
        " CASE WHEN len(string_split(name, '@')) >= 3 THEN split_part(name, '@', 3)"
        " ELSE 'unknown' END AS timestamp FROM names"
    ),
    "ing_artifact_glob": (
        f"WITH {_NAMES_CTE} SELECT name FROM names WHERE name GLOB 'engine-cli@*'"
    ),
    "ing_missing_builds": over_commits(
        f"SELECT revision, time, url FROM commits WHERE time >= {_SINCE} AND revision NOT IN"
        " (SELECT split_part(name, '@', 2) FROM names WHERE name LIKE 'engine-cli@%')"
        " ORDER BY time, revision",
        _NAMES_CTE,
    ),
    "ing_commit_window": over_commits(
        f"SELECT revision, time, url FROM commits WHERE time >= {_SINCE} ORDER BY time, revision"
    ),
    "ing_build_summary": (
        "SELECT count(*) FILTER (o_orderstatus <> 'P') AS successful,"
        " count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS total FROM orders"
    ),
    "hist_day_bucket": over_commits(
        "SELECT revision, time, url, CAST(date_trunc('day', time) AS TIMESTAMP) AS day FROM commits"
    ),
    "hist_daily_pick": over_commits(
        "SELECT revision, CAST(day AS TIMESTAMP) AS day, time, url FROM picks WHERE rn = 1"
        " ORDER BY time DESC",
        _PICKS,
    ),
    "hist_daily_pick_repeats": over_commits(
        "SELECT revision, CAST(day AS TIMESTAMP) AS day, time, url FROM (SELECT *,"
        " first_value(revision) OVER (PARTITION BY day ORDER BY time DESC, revision DESC)"
        " AS first_rev FROM (SELECT 'c' || right(revision, 1) AS revision, time, url,"
        " date_trunc('day', time) AS day FROM commits)) WHERE first_rev = revision",
    ),
    "hist_command_rows": over_commits(
        "SELECT './build.sh ' || revision AS command FROM picks WHERE rn = 1 ORDER BY time DESC",
        _PICKS,
    ),
}


def queries():
    return {name: globals()[f"_{name}"] for name in _SQL}


def oracle_sql():
    return dict(_SQL)
