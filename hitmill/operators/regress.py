"""Regression analytics over a table of query timings.

``results`` has the columns of ``sources.results.RESULTS_SCHEMA``. A revision's
time is text with an offset; times of different offsets do not sort as text, so
everything here parses to UTC first. ``lexicographic=True`` compares the text
instead, for parity with reports that do.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.functions.ordering import down, up
from hitmill.functions.quantiles import group_median
from hitmill.functions.times import iso_utc, to_utc

# The normalisation offset in seconds and the names of chart lines.
OFFSET_SECONDS = 0.01
AVERAGE_SERIES = "Average Normalized Time"
MEDIAN_SERIES = "Median Normalized Time"
SAME_TIME = "INTERVAL 1 SECOND"


def row_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("row_count"))


def query_rows(results: DataFrame) -> DataFrame:
    """Timed query runs; table creations are left out."""
    return results.where(F.col("query_type") == "query")


def _revision_time(lexicographic: bool):
    column = F.col("git_revision_timestamp")
    return column if lexicographic else to_utc(column)


def overall(results: DataFrame, lexicographic: bool = False) -> DataFrame:
    """Distinct revisions and queries, rows, and the span of revision times.

    Rows are first reduced to one per (revision, query, time text), which the
    map-side combine does before any shuffle. The two distinct counts then expand
    that small table instead of the timings, and each time text is parsed once.
    """
    time = _revision_time(lexicographic)
    pairs = (
        query_rows(results)
        .groupBy("git_revision", "query_name", "git_revision_timestamp")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pairs.agg(
        F.count_distinct("git_revision").alias("total_revisions"),
        F.count_distinct("query_name").alias("total_queries"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_measurements"),
        F.min(time).alias("earliest_revision"),
        F.max(time).alias("latest_revision"),
    )


def baseline(results: DataFrame) -> DataFrame:
    """The fastest time of every query over all revisions."""
    return query_rows(results).groupBy("query_name").agg(
        F.min("execution_time").alias("baseline_time")
    )


def normalize(
    results: DataFrame, best: DataFrame | None = None, offset: float = OFFSET_SECONDS
) -> DataFrame:
    """Every timed run relative to the fastest run of its query, at least 1.0.

    An equi-join with the baseline, not a window: a window would send all rows of
    a query to one task. ``best`` may be a staged ``baseline``; its size is then
    known, and the timings are not shuffled when it is small enough to broadcast.
    """
    best = baseline(results) if best is None else best
    return (
        query_rows(results)
        .join(best, "query_name")
        .select(
            "git_revision",
            "git_revision_timestamp",
            "query_name",
            "execution_time",
            "baseline_time",
            (
                (F.lit(offset) + F.col("execution_time")) / (F.lit(offset) + F.col("baseline_time"))
            ).alias("normalized_time"),
        )
    )


def trend(normalized: DataFrame) -> DataFrame:
    """Mean and median of the normalised rows of every revision."""
    return group_median(
        normalized,
        ["git_revision", "git_revision_timestamp"],
        "normalized_time",
        [F.avg("normalized_time").alias("avg_time")],
        "median_time",
    )


def per_query(normalized: DataFrame) -> DataFrame:
    """Median of the normalised rows of every revision and query."""
    return group_median(
        normalized,
        ["git_revision", "git_revision_timestamp", "query_name"],
        "normalized_time",
        name="median_time",
    )


def by_text_time(medians: DataFrame) -> DataFrame:
    """Rows of ``trend`` or ``per_query`` in the order of their time text."""
    keys = ["git_revision_timestamp", "query_name", "git_revision"]
    return medians.orderBy(*[up(key) for key in keys if key in medians.columns])


def with_utc(df: DataFrame) -> DataFrame:
    """Replace the text time by UTC, in time order."""
    return df.withColumn("git_revision_timestamp", to_utc("git_revision_timestamp")).orderBy(
        up("git_revision_timestamp"), up("git_revision")
    )


def most_recent(results: DataFrame, lexicographic: bool = False) -> DataFrame:
    """The latest revision time of timed runs, one row."""
    return query_rows(results).agg(F.max(_revision_time(lexicographic)).alias("most_recent"))


def revision_times(results: DataFrame, lexicographic: bool = False) -> DataFrame:
    """The earliest time of every revision that has timed runs."""
    texts = query_rows(results).select("git_revision", "git_revision_timestamp").distinct()
    return texts.groupBy("git_revision").agg(
        F.min(_revision_time(lexicographic)).alias("revision_time")
    )


# --- markers ----------------------------------------------------------------


def markers(releases: DataFrame, events: DataFrame, times: DataFrame) -> DataFrame:
    """Labelled revisions placed in time; revisions without runs are dropped.

    ``releases`` and ``events`` have one row per revision (revision, label);
    ``times`` comes from ``revision_times``.
    """
    tagged = releases.select("revision", "label", F.lit("release").alias("tag")).unionByName(
        events.select("revision", "label", F.lit("event").alias("tag"))
    )
    return tagged.join(times, tagged["revision"] == times["git_revision"]).select(
        "tag",
        "revision",
        F.when(F.col("tag") == "event", F.concat(F.lit("Event: "), "label"))
        .otherwise(F.col("label"))
        .alias("text"),
        "revision_time",
    )


def hide_markers(marks: DataFrame, kind: str) -> DataFrame:
    """Drop the markers of one kind; untagged ones go as well."""
    return marks.where(F.col("tag").isNotNull() & (F.col("tag") != kind))


def most_recent_release(
    releases: DataFrame, times: DataFrame | None = None, pick: str = "newest"
) -> DataFrame:
    """One release: the newest by revision time, or the last of the list.

    ``releases`` has the columns revision and position.
    """
    if pick == "last":
        return releases.agg(F.max_by("revision", "position").alias("revision"))
    known = releases.join(times, releases["revision"] == times["git_revision"])
    newest = F.max(F.struct("revision_time", "position", "revision"))["revision"]
    return known.agg(newest.alias("revision"))


# --- chart lines ------------------------------------------------------------


def rank_queries(medians: DataFrame) -> DataFrame:
    """Queries by the mean of their medians, slowest first."""
    return (
        medians.groupBy("query_name")
        .agg(F.avg("median_time").alias("mean_median"))
        .orderBy(down("mean_median"), up("query_name"))
    )


def _points(lines: DataFrame) -> DataFrame:
    return lines.select(
        "series", "time", iso_utc("time").alias("x"), "y", F.col("git_revision").alias("revision")
    )


def trend_series(trends: DataFrame) -> DataFrame:
    """The two overall chart lines, one row per point in line and time order.

    Points stay rows: a line of any length is never gathered into one value.
    """
    long = trends.unpivot(
        ["git_revision", "git_revision_timestamp"], ["avg_time", "median_time"], "metric", "y"
    )
    lines = long.select(
        F.when(F.col("metric") == "avg_time", AVERAGE_SERIES).otherwise(MEDIAN_SERIES).alias("series"),
        to_utc("git_revision_timestamp").alias("time"),
        "y",
        "git_revision",
    )
    return _points(lines).orderBy(up("series"), up("time"), up("revision"))


def query_series(medians: DataFrame) -> DataFrame:
    """One chart line per query, slowest query first, points in time order."""
    ranks = medians.groupBy(F.col("query_name").alias("ranked")).agg(
        F.avg("median_time").alias("mean_median")
    )
    lines = medians.join(ranks, F.col("query_name") == F.col("ranked")).select(
        F.col("query_name").alias("series"),
        to_utc("git_revision_timestamp").alias("time"),
        F.col("median_time").alias("y"),
        "git_revision",
        "mean_median",
    )
    return lines.orderBy(down("mean_median"), up("series"), up("time"), up("git_revision")).select(
        "series",
        "time",
        iso_utc("time").alias("x"),
        "y",
        F.col("git_revision").alias("revision"),
        "mean_median",
    )


# --- chart filters ----------------------------------------------------------
# ``points`` are the rows of a chart line: at least time and revision. ``as_of``
# stands for the moment the report is looked at.


def _release_flag(points: DataFrame, releases: DataFrame) -> DataFrame:
    flags = releases.select(F.col("revision").alias("_release")).distinct()
    return points.join(flags, points["revision"] == flags["_release"], "left")


def only_releases_and_latest(
    points: DataFrame, releases: DataFrame, latest: DataFrame
) -> DataFrame:
    """Points of releases, and those within a second of the most recent time.

    ``latest`` is the one-row result of ``most_recent``.
    """
    when = latest.scalar()
    near = (F.col("time") > when - F.expr(SAME_TIME)) & (F.col("time") < when + F.expr(SAME_TIME))
    kept = _release_flag(points, releases).where(F.col("_release").isNotNull() | near)
    return in_line_order(kept.drop("_release"))


def exclude_releases(points: DataFrame, releases: DataFrame) -> DataFrame:
    flags = releases.select(F.col("revision").alias("_release"))
    return in_line_order(points.join(flags, points["revision"] == flags["_release"], "left_anti"))


def in_line_order(points: DataFrame) -> DataFrame:
    """Points in the order of their chart lines, which a join does not keep."""
    orders = {"mean_median": down, "series": up, "time": up, "revision": up}
    return points.orderBy(*[order(name) for name, order in orders.items() if name in points.columns])


def _cutoff(as_of: datetime, days: int):
    return F.lit((as_of - timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz")


def last_days(
    points: DataFrame, as_of: datetime, days: int, release: DataFrame | None = None
) -> DataFrame:
    """Points of the last ``days`` days.

    Longer views also keep all points of one release, given as the one-row
    result of ``most_recent_release``; the week view passes none.
    """
    recent = F.col("time") >= _cutoff(as_of, days)
    if release is None:
        return points.where(recent)
    return points.where(recent | (F.col("revision") == release.scalar()))


def last_week(points: DataFrame, as_of: datetime) -> DataFrame:
    """Points of the last seven days; this view shows no markers."""
    return last_days(points, as_of, 7)


def markers_since(marks: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Markers of the last ``days`` days; the week view has none."""
    if days == 7:
        return marks.where(F.lit(False))
    return marks.where(F.col("revision_time") >= _cutoff(as_of, days))
