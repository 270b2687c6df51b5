"""From raw run output to the table of query timings."""

from __future__ import annotations

import fnmatch
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmill.functions.ordering import up
from hitmill.functions.whitespace import NOT_SPACE, SPACE

# The word that marks a timing line, its form, the names of run types, the
# repeats per query, and the separator and filler of artifact names.
TIMING_WORD = "Elapsed"
NUMBER = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)"
FIRST_RUN = "table_creation"
OTHER_RUN = "query"
REPEATS = 5
SECOND_OF_THREE = rf"(?i)\A{SPACE}*{NOT_SPACE}+{SPACE}+({NUMBER}){SPACE}+{NOT_SPACE}"
NAME_SEPARATOR = "@"
UNKNOWN = "unknown"


def extract_timings(lines: DataFrame) -> DataFrame:
    """Timing lines as seconds: the second word of lines with at least three.

    Lines whose second word is no number are skipped. All other columns of
    ``lines`` (at least log, line_no, line) stay.
    """
    second = F.regexp_extract("line", SECOND_OF_THREE, 1)
    seconds = F.nullif(second, F.lit("")).try_cast("double")
    kept = [name for name in lines.columns if name != "line"]
    return (
        lines.where(F.col("line").contains(TIMING_WORD))
        .select(*kept, seconds.alias("execution_time"))
        .where(F.col("execution_time").isNotNull())
    )


def label_runs(
    timings: DataFrame,
    query_name: Column,
    benchmark_name: str,
    run_timestamp: str,
    git_revision: Column | str | None,
    git_revision_timestamp: Column | str | None,
    num_cores: int,
) -> DataFrame:
    """Kept timings as result rows; the first one of a log created the table.

    The first line of every log comes from an aggregation, so a very long log is
    neither sorted nor sent to one task.
    """

    def meta(value: Column | str | None) -> Column:
        return value if isinstance(value, Column) else F.lit(value or "")

    firsts = timings.groupBy(F.col("log").alias("_log")).agg(F.min("line_no").alias("_first"))
    joined = timings.join(firsts, F.col("log") == F.col("_log"))
    return joined.select(
        F.lit(benchmark_name).alias("benchmark_name"),
        query_name.alias("query_name"),
        F.when(F.col("line_no") == F.col("_first"), FIRST_RUN).otherwise(OTHER_RUN).alias("query_type"),
        "execution_time",
        F.lit(run_timestamp).alias("run_timestamp"),
        meta(git_revision).alias("git_revision"),
        meta(git_revision_timestamp).alias("git_revision_timestamp"),
        F.lit(num_cores).cast("bigint").alias("num_cores"),
    )


def expected_runs(results: DataFrame, query_names: DataFrame, expected: int = REPEATS) -> DataFrame:
    """Timed runs per listed query and revision, and whether they are complete.

    A listed query that never ran appears once, without a revision.
    """
    runs = (
        results.where(F.col("query_type") == OTHER_RUN)
        .groupBy(F.col("query_name").alias("_name"), "git_revision")
        .agg(F.count(F.lit(1)).alias("_runs"))
    )
    listed = query_names.select("query_name").distinct()
    return listed.join(runs, F.col("query_name") == F.col("_name"), "left").select(
        "query_name",
        "git_revision",
        F.coalesce("_runs", F.lit(0)).alias("runs"),
        (F.coalesce("_runs", F.lit(0)) == expected).alias("complete"),
    )


def new_revisions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of revisions that are not stored yet; the empty revision never is."""
    done = (
        stored.where(F.col("git_revision") != "")
        .select(F.col("git_revision").alias("_done"))
        .distinct()
    )
    return batch.join(done, F.col("git_revision") == F.col("_done"), "left_anti")


# --- artifacts and builds ---------------------------------------------------


def parse_artifacts(names: DataFrame) -> DataFrame:
    """Version and time of names like ``tool@version@time``."""
    parts = F.split("name", NAME_SEPARATOR)
    whole = F.size(parts) >= 3
    return names.select(
        "name",
        F.when(whole, F.get(parts, F.lit(1))).otherwise(UNKNOWN).alias("version"),
        F.when(whole, F.get(parts, F.lit(2))).otherwise(UNKNOWN).alias("timestamp"),
    )


def select_artifacts(names: DataFrame, pattern: str) -> DataFrame:
    """Names that match a shell pattern."""
    regex = fnmatch.translate(pattern).replace(r"\Z", r"\z")
    return names.where(F.col("name").rlike(r"\A" + regex))


def commit_window(commits: DataFrame, as_of: date, days: int) -> DataFrame:
    """Commits since the day ``days`` days before ``as_of``, oldest first."""
    since = F.date_sub(F.lit(as_of), days)
    return commits.where(F.col("time") >= since.cast("timestamp")).orderBy(up("time"), up("revision"))


def missing_builds(
    commits: DataFrame, names: DataFrame, as_of: date, days: int, prefix: str
) -> DataFrame:
    """Recent commits without an artifact named ``prefix@revision...``."""
    parts = F.split("name", NAME_SEPARATOR)
    built = (
        names.where(F.col("name").startswith(f"{prefix}{NAME_SEPARATOR}"))
        .select(F.get(parts, F.lit(1)).alias("_built"))
        .distinct()
    )
    return commit_window(commits, as_of, days).join(
        built, F.col("revision") == F.col("_built"), "left_anti"
    )


def build_summary(outcomes: DataFrame, ok: str = "ok") -> DataFrame:
    """Successful, failed and all builds of a table of outcomes."""
    return outcomes.agg(
        F.count_if(F.col(ok)).alias("successful"),
        F.count_if(~F.col(ok)).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
