"""The regression report as tables: shared steps are computed once."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame

from hitmill.operators import regress
from hitmill.staging import stage

# The periods a reader can choose, in days.
PERIOD_DAYS = {"last_week": 7, "last_3_months": 90, "last_6_months": 180}
ALL = "all"
RELEASES_AND_LATEST = "releases_vs_main"


class Report:
    """All tables behind the report, each computed when it is first asked for.

    ``releases`` (revision, label, position) and ``events`` (revision, label) have
    one row per revision. The timings are read for the baseline, the medians and
    the statistics; charts, markers and filters work on staged medians.
    """

    def __init__(self, results: DataFrame, releases: DataFrame, events: DataFrame) -> None:
        self.results, self.releases, self.events = results, releases, events

    @cached_property
    def overall(self) -> DataFrame:
        return regress.overall(self.results)

    @cached_property
    def scores(self) -> DataFrame:
        return regress.normalize(self.results, stage(regress.baseline(self.results), "baseline"))

    @cached_property
    def trend(self) -> DataFrame:
        return stage(regress.trend(self.scores), "trend")

    @cached_property
    def per_query(self) -> DataFrame:
        return stage(regress.per_query(self.scores), "per-query")

    @cached_property
    def times(self) -> DataFrame:
        return stage(regress.revision_times(self.results), "revision-times")

    @cached_property
    def ranking(self) -> DataFrame:
        return regress.rank_queries(self.per_query)

    @cached_property
    def performance(self) -> DataFrame:
        return regress.trend_series(self.trend)

    @cached_property
    def queries(self) -> DataFrame:
        return regress.query_series(self.per_query)

    @cached_property
    def markers(self) -> DataFrame:
        return regress.markers(self.releases, self.events, self.times)

    @cached_property
    def most_recent(self) -> DataFrame:
        return regress.most_recent(self.results)

    @cached_property
    def most_recent_release(self) -> DataFrame:
        return regress.most_recent_release(self.releases, self.times)


def chart_points(report: Report, name: str, period: str, as_of: datetime) -> DataFrame:
    """Points of one chart ("performance" or "queries") in one period."""
    points = {"performance": lambda: report.performance, "queries": lambda: report.queries}[name]()
    if period == ALL:
        return points
    if period == RELEASES_AND_LATEST:
        return regress.only_releases_and_latest(points, report.releases, report.most_recent)
    days = PERIOD_DAYS[period]
    return regress.last_days(points, as_of, days, None if days == 7 else report.most_recent_release)


def chart_markers(
    report: Report,
    period: str,
    as_of: datetime,
    show_releases: bool = True,
    show_events: bool = True,
) -> DataFrame:
    """Markers of both charts in one period."""
    marks = report.markers
    if period in PERIOD_DAYS:
        marks = regress.markers_since(marks, as_of, PERIOD_DAYS[period])
    for kind, shown in (("release", show_releases), ("event", show_events)):
        if not shown:
            marks = regress.hide_markers(marks, kind)
    return marks
