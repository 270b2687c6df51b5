"""Triage of comments that request benchmark runs.

All functions work on rows of ``sources.comments.COMMENTS_SCHEMA``. Those that
look at one comment alone are column expressions, so batch and streaming jobs
share them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitmill.functions.ordering import down, up
from hitmill.functions.whitespace import LINE_BREAK, SPACE, lines, no_texts, strip, words

# Triggers, limits and patterns of the request language.
QUEUE_TRIGGER = "show benchmark queue"
REQUEST_START = "run benchmark"
DEFAULT_PATTERN = rf"(?iu)\A{SPACE}*run{SPACE}+benchmarks{SPACE}*\z"
NAMED_PATTERN = rf"(?iu)\A{SPACE}*run{SPACE}+benchmark{SPACE}+([a-z0-9_\-{SPACE}]+)\z"
ENV_PATTERN = r"\A[A-Z_][A-Z0-9_]*=[a-zA-Z0-9._\-]+\z"
WINDOW_SECONDS = 3600
DEFAULT_SUITE = "default"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class RepoRules:
    """What one repository allows, and how its jobs are named and run."""

    repo: str
    suites: Sequence[str] = ()
    micro: Sequence[str] = ()
    suite_command: str = "compare-suite"
    micro_command: str = "compare-micro"
    key_prefix: str | None = None

    @property
    def names(self) -> list[str]:
        return sorted({*self.suites, *self.micro})


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def per_repo(rules: Sequence[RepoRules], value, default: Column) -> Column:
    """A constant per repository; the rules are program text, so nothing is joined."""
    chosen = None
    for rule in rules:
        here = F.col("repo") == rule.repo
        chosen = F.when(here, value(rule)) if chosen is None else chosen.when(here, value(rule))
    return default if chosen is None else chosen.otherwise(default)


# --- one comment ------------------------------------------------------------


def body_text() -> Column:
    return strip(F.coalesce("body", F.lit("")))


def trigger_line() -> Column:
    """The first line of the trimmed body."""
    return F.element_at(F.split(body_text(), LINE_BREAK, 2), 1)


def other_lines() -> Column:
    every = lines(body_text())
    return F.slice(every, F.lit(2), F.size(every))


def env_settings() -> Column:
    """Later lines that set a variable, trimmed; all other lines are ignored."""
    return F.filter(F.transform(other_lines(), strip), lambda line: line.rlike(ENV_PATTERN))


def requested_names(trigger: Column | None = None) -> Column:
    """The names of a well-formed request, an empty array for anything else."""
    trigger = trigger_line() if trigger is None else trigger
    return words(F.regexp_extract(trigger, NAMED_PATTERN, 1))


def pr_number() -> Column:
    """The last segment of the issue link."""
    path = F.regexp_replace(F.coalesce("issue_url", F.lit("")), r"/+\z", "")
    return F.element_at(F.split(path, "/"), -1)


def allowed_names(rules: Sequence[RepoRules]) -> Column:
    return per_repo(rules, lambda rule: _texts(rule.names), _texts([]))


def unsupported_names(rules: Sequence[RepoRules], trigger: Column | None = None) -> Column:
    """All words after the second of the trigger that the repository does not allow."""
    named = words(trigger_line() if trigger is None else trigger)
    named = F.slice(named, F.lit(3), F.greatest(F.size(named), F.lit(1)))
    allowed = allowed_names(rules)
    return F.filter(named, lambda name: ~F.array_contains(allowed, name))


def classify(comments: DataFrame, rules: Sequence[RepoRules]) -> DataFrame:
    """Add class, names, env, unsupported names and PR number to every comment.

    The class is default, named, queue, unsupported or none. Steps are columns of
    their own, so that Spark computes each of them once per comment.
    """
    trigger, asked, kind = F.col("_trigger"), F.col("_asked"), F.col("class")
    all_allowed = F.size(F.array_except(asked, allowed_names(rules))) == 0
    comment_class = (
        F.when(F.lower(body_text()) == QUEUE_TRIGGER, "queue")
        .when(trigger.rlike(DEFAULT_PATTERN), "default")
        .when((F.size(asked) > 0) & all_allowed, "named")
        .when(F.lower(trigger).startswith(REQUEST_START), "unsupported")
        .otherwise("none")
    )
    return (
        comments.withColumn("pr", pr_number())
        .withColumn("_trigger", trigger_line())
        .withColumn("_asked", requested_names(trigger))
        .withColumn("class", comment_class)
        .withColumns(
            {
                "names": F.when(kind == "named", asked).otherwise(no_texts()),
                "env": F.when(kind.isin("default", "named"), env_settings()).otherwise(no_texts()),
                "bad_names": F.when(kind == "unsupported", unsupported_names(rules, trigger)).otherwise(
                    no_texts()
                ),
            }
        )
        .drop("_trigger", "_asked")
    )


# --- many comments ----------------------------------------------------------


def recent(
    comments: DataFrame,
    as_of: datetime,
    seconds: int = WINDOW_SECONDS,
    limit: int | None = None,
) -> DataFrame:
    """The comments updated in the last ``seconds``; with a ``limit``, the newest per repository.

    For a limit, comments are counted per repository and second, which gives the
    second of the last row that can be among the newest. Only rows from there on
    are ranked, so a busy repository never meets in one task.
    """
    since = F.lit((as_of - timedelta(seconds=seconds)).isoformat(sep=" ")).cast("timestamp")
    found = comments.where(F.col("updated_at") >= since)
    if limit is None:
        return found
    second = F.date_trunc("second", "updated_at")
    down_to = Window.partitionBy("_repo").orderBy(down("_second"))
    enough = F.sum("_n").over(down_to.rowsBetween(Window.unboundedPreceding, Window.currentRow)) >= limit
    cutoffs = (
        found.groupBy(F.col("repo").alias("_repo"), second.alias("_second"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_enough", enough)
        .groupBy("_repo")
        .agg(F.max(F.when(F.col("_enough"), F.col("_second"))).alias("_cutoff"))
    )
    newest = Window.partitionBy("repo").orderBy(down("updated_at"), down("id"))
    return (
        found.join(cutoffs, F.col("repo").eqNullSafe(F.col("_repo")))
        .where(F.col("_cutoff").isNull() | (F.col("updated_at") >= F.col("_cutoff")))
        .drop("_repo", "_cutoff")
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def _flagged(left: DataFrame, right: DataFrame, keys: dict[str, str], flag: str) -> DataFrame:
    """Add a flag: does ``right`` have a row with these key values?"""
    marks = right.select(
        *[F.col(theirs).alias(f"_{flag}_{theirs}") for theirs in keys.values()]
    ).distinct()
    condition = [F.col(mine) == F.col(f"_{flag}_{theirs}") for mine, theirs in keys.items()]
    joined = left.join(marks, condition, "left")
    found = F.col(marks.columns[0]).isNotNull()
    return joined.withColumn(flag, found).drop(*marks.columns)


def with_allowed_user(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``user_allowed``; ``users`` has a column login."""
    return _flagged(comments, users, {"login": "login"}, "user_allowed")


def with_existing_job(comments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``job_exists``; ``jobs`` holds pending and done (repo, pr, comment_id)."""
    keys = {"repo": "repo", "pr": "pr", "id": "comment_id"}
    return _flagged(comments, jobs, keys, "job_exists")


def new_requests(comments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Comments without a job, pending or done."""
    marks = jobs.select(
        F.col("repo").alias("_repo"), F.col("pr").alias("_pr"), F.col("comment_id").alias("_id")
    )
    same = [F.col("repo") == F.col("_repo"), F.col("pr") == F.col("_pr"), F.col("id") == F.col("_id")]
    return comments.join(marks, same, "left_anti")


def mentioned_links(replies: DataFrame, comments: DataFrame) -> DataFrame:
    """(repo, pr, link) for every text of a link's length that a reply contains.

    "A reply contains the link" is a substring test. Testing all comments of a PR
    against all its replies grows with the square of a busy PR. Here every reply
    is cut into the pieces that could be a link, which makes the test an equi-join
    on the text: a reply is split before every "http", and the beginnings of the
    parts are taken in the lengths of the links of the same PR. Links of another
    form are looked for at every position. A PR's lengths are a set of numbers no
    larger than its longest link, so the pieces grow with the text of the replies
    alone. They are made distinct by (repo, pr, link), which spreads a busy PR.
    """
    link = F.coalesce("html_url", F.lit(""))
    plain = link.startswith("http") & (F.locate("http", link, 2) == 0)
    lengths = comments.groupBy(F.col("repo").alias("_repo"), F.col("pr").alias("_pr")).agg(
        F.collect_set(F.when(plain, F.length(link))).alias("_plain"),
        F.collect_set(F.when(~plain, F.length(link))).alias("_other"),
    )
    body = F.coalesce("body", F.lit(""))

    def beginnings(part: Column) -> Column:
        fitting = F.filter("_plain", lambda n: part.startswith("http") & (n <= F.length(part)))
        return F.transform(fitting, lambda n: F.substring(part, F.lit(1), n))

    def anywhere(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(body) - n + 1, F.lit(1)))
        return F.transform(starts, lambda start: F.substring(body, start, n))

    parts = F.when(body.contains("http"), F.split(body, "(?=http)")).otherwise(no_texts())
    other = F.filter("_other", lambda n: n <= F.length(body))
    found = F.concat(
        F.flatten(F.transform(parts, beginnings)), F.flatten(F.transform(other, anywhere))
    )
    same = [F.col("repo") == F.col("_repo"), F.col("pr") == F.col("_pr")]
    return (
        replies.join(lengths, same)
        .select("repo", "pr", F.explode(found).alias("link"))
        .distinct()
    )


def with_reply(comments: DataFrame, replies: DataFrame) -> DataFrame:
    """Add ``replied``: some reply of the comment's PR contains the comment's link.

    ``replies`` has (repo, pr, body); comments need ``pr`` (see ``classify``).
    """
    keys = {"repo": "repo", "pr": "pr", "html_url": "link"}
    return _flagged(comments, mentioned_links(replies, comments), keys, "replied")


def route(
    comments: DataFrame,
    rules: Sequence[RepoRules],
    users: DataFrame,
    jobs: DataFrame | None = None,
    replies: DataFrame | None = None,
) -> DataFrame:
    """One disposition per comment.

    queue, not_allowed and unsupported want a reply, unless one exists
    (``reply_due``); schedule starts a job; duplicate has one; none needs nothing.
    """
    seen = with_allowed_user(classify(comments, rules), users)
    seen = seen.withColumn("job_exists", F.lit(False)) if jobs is None else with_existing_job(seen, jobs)
    seen = seen.withColumn("replied", F.lit(False)) if replies is None else with_reply(seen, replies)
    known = per_repo(rules, lambda rule: F.lit(True), F.lit(False))
    disposition = (
        F.when(~known | (F.col("pr") == "") | (F.col("class") == "none"), "none")
        .when(F.col("class") == "queue", "queue")
        .when(~F.col("user_allowed"), "not_allowed")
        .when(F.col("class") == "unsupported", "unsupported")
        .when(F.col("job_exists"), "duplicate")
        .otherwise("schedule")
    )
    wants_reply = F.col("disposition").isin("queue", "not_allowed", "unsupported")
    return seen.withColumn("disposition", disposition).withColumn(
        "reply_due", wants_reply & ~F.col("replied")
    )


# --- jobs -------------------------------------------------------------------


def job_key(rules: Sequence[RepoRules]) -> Column:
    """``<pr>_<comment>``, or ``<prefix><pr>-<comment>`` where a prefix is set."""
    comment = F.col("id").cast("string")

    def key(rule: RepoRules) -> Column:
        if rule.key_prefix is None:
            return F.concat("pr", F.lit("_"), comment)
        return F.concat(F.lit(rule.key_prefix), "pr", F.lit("-"), comment)

    return per_repo(rules, key, F.concat("pr", F.lit("_"), comment))


def job_rows(requests: DataFrame, rules: Sequence[RepoRules]) -> DataFrame:
    """One command row per requested name, one row for the default suite.

    ``requests`` are classified comments of the classes default and named.
    """
    asked = requests.where(F.col("class").isin("default", "named"))
    micro = F.array_contains(
        per_repo(rules, lambda rule: _texts(rule.micro), _texts([])), F.col("name")
    )
    suite_command = per_repo(rules, lambda rule: F.lit(rule.suite_command), F.lit(None))
    micro_command = per_repo(rules, lambda rule: F.lit(rule.micro_command), F.lit(None))
    kind = F.when(F.col("name").isNull(), DEFAULT_SUITE).when(micro, "micro").otherwise("suite")
    exploded = asked.select(
        job_key(rules).alias("job"),
        "repo",
        "pr",
        F.col("id").alias("comment_id"),
        "env",
        F.posexplode_outer("names").alias("position", "name"),
    )
    return exploded.select(
        "job",
        "repo",
        "pr",
        "comment_id",
        F.coalesce("position", F.lit(0)).alias("position"),
        kind.alias("kind"),
        F.coalesce("name", F.lit(DEFAULT_SUITE)).alias("name"),
        F.when(kind == "micro", micro_command).otherwise(suite_command).alias("command"),
        "env",
    )


# The line forms of a job text.
JOB_LINE_BREAK = r"\r\n|\r|\n"
USER_LINE = "# User:"
COMMENT_LINE = "# Comment:"
SUITES_WORD = "BENCHMARKS="
MICRO_WORD = "BENCH_NAME="
EXPORT_START = "export "
SUITES_PATTERN = 'BENCHMARKS="([^"]+)"'
MICRO_PATTERN = 'BENCH_NAME="([^"]+)"'


def job_meta(jobs: DataFrame) -> DataFrame:
    """User, comment link, benchmarks and settings of job texts (job, text).

    Each line has one meaning, the first that fits. The last user and the last
    comment line count; an empty user line does not.
    """
    def after(prefix: str):
        return lambda line: strip(F.substring(line, F.lit(len(prefix) + 1), F.length(line)))

    def line_names(line: Column) -> Column:
        one = F.regexp_extract(line, MICRO_PATTERN, 1)
        return (
            F.when(line.contains(SUITES_WORD), words(F.regexp_extract(line, SUITES_PATTERN, 1)))
            .when(line.contains(MICRO_WORD) & (one != ""), F.array(one))
            .otherwise(no_texts())
        )

    def sets_variable(line: Column) -> Column:
        named = line.contains(SUITES_WORD) | line.contains(MICRO_WORD)
        return ~named & line.startswith(EXPORT_START) & line.contains("=")

    def is_user(line: Column) -> Column:
        return line.startswith(USER_LINE)

    def is_comment(line: Column) -> Column:
        return line.startswith(COMMENT_LINE)

    every, rest = F.col("_lines"), F.col("_rest")
    users = F.filter(F.transform(F.filter(every, is_user), after(USER_LINE)), lambda user: user != "")
    last_comment = F.try_element_at(
        F.transform(F.filter(every, is_comment), after(COMMENT_LINE)), F.lit(-1)
    )
    others = [name for name in jobs.columns if name != "text"]
    return (
        jobs.withColumn("_lines", F.transform(F.split("text", JOB_LINE_BREAK), strip))
        .withColumn("_rest", F.filter(every, lambda line: ~is_user(line) & ~is_comment(line)))
        .select(
            *others,
            F.coalesce(F.try_element_at(users, F.lit(-1)), F.lit(UNKNOWN)).alias("user"),
            F.coalesce(last_comment, F.lit("")).alias("comment"),
            F.flatten(F.transform(rest, line_names)).alias("benchmarks"),
            F.transform(F.filter(rest, sets_variable), after(EXPORT_START)).alias("env"),
        )
    )


def queue(pending: DataFrame) -> DataFrame:
    """Pending jobs, oldest first, as the rows of the queue reply.

    ``pending`` is ``job_meta`` over jobs with a column ``modified``.
    """
    named = F.concat_ws(" ", "benchmarks")
    settings = F.concat(F.lit(" (env: "), F.concat_ws(" ", "env"), F.lit(")"))
    shown = F.concat(
        F.when(F.size("benchmarks") > 0, named).otherwise(DEFAULT_SUITE),
        F.when(F.size("env") > 0, settings).otherwise(""),
    )
    return pending.orderBy(up("modified"), up("job")).select(
        "job",
        "user",
        shown.alias("benchmarks"),
        F.when(F.col("comment") != "", F.col("comment")).otherwise(UNKNOWN).alias("comment"),
        "modified",
    )
