"""Picks from a commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.functions.ordering import down


def with_bucket(commits: DataFrame, width: str = "1 day") -> DataFrame:
    """Add the start of the time bucket of every commit, counted from 1970-01-01."""
    if width == "1 day":
        start = F.date_trunc("day", "time")
    else:
        start = F.window("time", width)["start"]
    return commits.withColumn("day", start)


def daily_pick(commits: DataFrame, keep_repeats: bool = False, width: str = "1 day") -> DataFrame:
    """The last commit of every day, newest day first.

    One aggregation with a map-side combine, so a busy day is reduced before the
    shuffle. Commits of equal time are decided by the higher revision.
    ``keep_repeats`` returns every row of the day that carries the picked
    revision, as the first-value form of this query does.
    """
    bucketed = with_bucket(commits, width)
    picks = bucketed.groupBy("day").agg(
        F.max(F.struct("time", "revision", "url")).alias("pick")
    )
    if keep_repeats:
        picked = picks.select(F.col("day").alias("_day"), F.col("pick.revision").alias("_revision"))
        same = (bucketed["day"] == picked["_day"]) & (bucketed["revision"] == picked["_revision"])
        rows = bucketed.join(picked, same, "left_semi").select("revision", "day", "time", "url")
    else:
        rows = picks.select("pick.revision", "day", "pick.time", "pick.url")
    return rows.orderBy(down("time"), down("revision"))


def command_rows(commits: DataFrame, command: str) -> DataFrame:
    """One command line per commit, newest first."""
    ordered = commits.orderBy(down("time"), down("revision"))
    return ordered.select(F.concat(F.lit(f"{command} "), "revision").alias("command"))
