"""Comment triage on the derived comments table, with oracle SQL.

Lists are shown as comma-separated text in the results.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.operators import triage
from hitmill.operators.triage import RepoRules
from hitmill.plans.shape import result
from hitmill.plans.tables import comments, derived, derived_cte, over_comments
from hitmill.sources.comments import stream_comments
from hitmill.staging import new_path
from hitmill.streaming import triage as streaming

RULES = (
    RepoRules("org/a", suites=("tpch", "tpch_mem"), micro=("sql_planner",)),
    RepoRules("org/b", micro=("sql_planner", "tpch", "tpch_mem"), key_prefix="b-"),
)
AS_OF = datetime(2024, 1, 30, 12)
SECONDS = 86400
LIMIT = 100

# --- side tables ------------------------------------------------------------

_USERS = "SELECT DISTINCT 'u' || CAST(c_custkey % 15 AS STRING) AS login FROM {customer}"
_JOBS = (
    "SELECT CASE WHEN event_id * 2 % 3 = 0 THEN 'org/b' ELSE 'org/a' END AS repo,"
    " CAST(event_id * 2 % 400 AS STRING) AS pr, event_id * 2 AS comment_id FROM {events}"
)
_REPLIES = (
    "SELECT CASE WHEN event_id % 3 = 0 THEN 'org/b' ELSE 'org/a' END AS repo,"
    " CAST(event_id % 400 AS STRING) AS pr,"
    " CASE event_id % 4"
    " WHEN 0 THEN 'thanks (https://x.example/c/' || CAST(event_id % 9000 AS STRING) || ').'"
    " WHEN 1 THEN 'see https://x.example/c/' || CAST(event_id % 9000 AS STRING) || '7 or more'"
    " WHEN 2 THEN 'x.example/c/' || CAST(event_id % 9000 AS STRING)"
    " ELSE '' END AS body FROM {events}"
)
_JOB_TEXTS = (
    "SELECT 'j' || CAST(event_id AS STRING) || '.sh' AS job, CAST(ts AS TIMESTAMP) AS modified,"
    " CASE event_id % 4"
    " WHEN 0 THEN '#!/usr/bin/env bash' || {lf} || '# Comment: https://x.example/c/'"
    " || CAST(event_id AS STRING) || {lf} || '# User: u' || CAST(user_id AS STRING) || {lf}"
    " || 'export MEM_LIMIT=1G' || {lf} || 'BENCHMARKS=\"tpch tpch_mem\" ./run' || {lf}"
    " || 'BENCH_NAME=\"sql_planner\" ./run'"
    " WHEN 1 THEN './run' || {lf} || 'export X'"
    " WHEN 2 THEN '# User:  ' || {lf} || '# User: first' || {lf} || '# User: second' || {lf}"
    " || 'export A=1' || {lf} || '  export B=2  '"
    " ELSE '  # Comment: here' || {lf} || 'BENCHMARKS=\"\" ./run' || {lf}"
    " || '# Body: BENCH_NAME=\"q\"' END AS text FROM {events}"
)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "users", _USERS, "customer")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "jobs", _JOBS, "events")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "replies", _REPLIES, "events")


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "job-texts", _JOB_TEXTS, "events", lf="char(10)")


def classified(spark, sf_dir):
    return triage.classify(comments(spark, sf_dir), RULES)


def routed(spark, sf_dir):
    return triage.route(
        comments(spark, sf_dir),
        RULES,
        users(spark, sf_dir),
        jobs(spark, sf_dir),
        replies(spark, sf_dir),
    )


def shown(name: str):
    return F.concat_ws(",", name).alias(name)


# --- queries ----------------------------------------------------------------


def _tri_window(spark, sf_dir):
    found = triage.recent(comments(spark, sf_dir), AS_OF, SECONDS)
    return result(found.select("repo", "id", "updated_at"))


def _tri_window_limit(spark, sf_dir):
    newest = triage.recent(comments(spark, sf_dir), AS_OF, SECONDS, LIMIT)
    return result(newest.select("repo", "id", "updated_at"))


def _tri_split(spark, sf_dir):
    return comments(spark, sf_dir).select(
        "id",
        triage.trigger_line().alias("trigger"),
        F.concat_ws("|", triage.other_lines()).alias("rest"),
    )


def _tri_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("id", "class")


def _tri_names(spark, sf_dir):
    return comments(spark, sf_dir).select(
        "id", F.concat_ws(",", triage.requested_names()).alias("names")
    )


def _tri_allowed_names(spark, sf_dir):
    names = triage.requested_names()
    ok = F.size(F.array_except(names, triage.allowed_names(RULES))) == 0
    return comments(spark, sf_dir).select("id", "repo", ((F.size(names) > 0) & ok).alias("allowed"))


def _tri_bad_names(spark, sf_dir):
    return classified(spark, sf_dir).select("id", shown("bad_names"))


def _tri_env(spark, sf_dir):
    return comments(spark, sf_dir).select("id", F.concat_ws(",", triage.env_settings()).alias("env"))


def _tri_allowed_user(spark, sf_dir):
    flagged = triage.with_allowed_user(comments(spark, sf_dir), users(spark, sf_dir))
    return flagged.select("id", "login", "user_allowed")


def _tri_pr_number(spark, sf_dir):
    return comments(spark, sf_dir).select("id", triage.pr_number().alias("pr"))


def _tri_dedupe(spark, sf_dir):
    return triage.new_requests(classified(spark, sf_dir), jobs(spark, sf_dir)).select("repo", "pr", "id")


def _tri_already_replied(spark, sf_dir):
    flagged = triage.with_reply(classified(spark, sf_dir), replies(spark, sf_dir))
    return flagged.select("id", "pr", "replied")


def _tri_route(spark, sf_dir):
    return routed(spark, sf_dir).select("id", "disposition", "reply_due")


def _tri_job_rows(spark, sf_dir):
    scheduled = routed(spark, sf_dir).where(F.col("disposition") == "schedule")
    rows = triage.job_rows(scheduled, RULES)
    return rows.select("job", "comment_id", "position", "kind", "name", "command", shown("env"))


def _tri_job_key(spark, sf_dir):
    return classified(spark, sf_dir).select("id", triage.job_key(RULES).alias("job"))


def _tri_job_meta(spark, sf_dir):
    meta = triage.job_meta(job_texts(spark, sf_dir))
    return meta.select("job", "user", "comment", shown("benchmarks"), shown("env"))


def _tri_queue(spark, sf_dir):
    return result(triage.queue(triage.job_meta(job_texts(spark, sf_dir))))


def _tri_stream(spark, sf_dir):
    """The route of the batch job from a stream over the same comments.

    They arrive in three batches without regard to their times: some first as a draft
    that is corrected later, and a part once more at the end.
    """
    arrived, out, checkpoint = (
        new_path(spark, name) for name in ("comments", "routed", "routed-checkpoint")
    )
    every, first, edited = comments(spark, sf_dir), F.col("id") % 2 == 0, F.col("id") % 12 == 2
    drafts = every.where(edited).withColumns(
        {
            "body": F.concat("body", F.lit("h")),
            "updated_at": F.col("updated_at") - F.expr("INTERVAL 5 MINUTES"),
        }
    )
    side = users(spark, sf_dir), jobs(spark, sf_dir), replies(spark, sf_dir)
    for rows in (every.where(first & ~edited).unionByName(drafts), every.where(~first), every.where(first)):
        rows.write.mode("append").parquet(arrived)
        streaming.route_batches(
            stream_comments(spark, arrived), out, checkpoint, RULES, *[lambda _, t=t: t for t in side]
        ).awaitTermination()
    return streaming.dispositions(spark, out).select("id", "disposition", "reply_due")


_TRIMMED = (
    "trimmed AS (SELECT *, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS t FROM comments)"
)
_SPLIT = (
    "split AS (SELECT *, string_split_regex(t, '\\r\\n|\\r|\\n') AS ls,"
    " string_split_regex(t, '\\r\\n|\\r|\\n')[1] AS first,"
    " regexp_extract(issue_url, '([0-9]+)/*$', 1) AS pr FROM trimmed)"
)
_NAMED = (
    "named AS (SELECT *, list_filter(string_split_regex(regexp_extract(first,"
    " '^\\s*run\\s+benchmark\\s+([a-z0-9_\\s-]+)$', 1, 'i'), '\\s+'), lambda w: w <> '') AS names,"
    " list_filter(list_transform(ls[2:], lambda l: trim(l)),"
    " lambda l: regexp_full_match(l, '[A-Z_][A-Z0-9_]*=[a-zA-Z0-9._-]+')) AS env FROM split)"
)
_CLASSED = (
    "classed AS (SELECT *, CASE WHEN lower(t) = 'show benchmark queue' THEN 'queue'"
    " WHEN regexp_full_match(first, '\\s*run\\s+benchmarks\\s*', 'i') THEN 'default'"
    " WHEN len(names) > 0 AND list_has_all(['tpch', 'tpch_mem', 'sql_planner'], names) THEN 'named'"
    " WHEN starts_with(lower(first), 'run benchmark') THEN 'unsupported' ELSE 'none' END AS class"
    " FROM named)"
)
_KEYED = (
    "keyed AS (SELECT *, CASE repo WHEN 'org/b' THEN 'b-' || pr || '-' || id"
    " ELSE pr || '_' || id END AS job FROM classed)"
)
_CHAIN = (_TRIMMED, _SPLIT, _NAMED, _CLASSED, _KEYED)
_USERS_CTE = derived_cte("users", _USERS, "customer")
_JOBS_CTE = derived_cte("jobs", _JOBS, "events")
_REPLIES_CTE = derived_cte("replies", _REPLIES, "events")
_ROUTED = (
    "replied AS (SELECT DISTINCT c.id FROM classed c JOIN replies r"
    " ON r.repo = c.repo AND r.pr = c.pr WHERE contains(r.body, c.html_url)),\n"
    "decided AS (SELECT k.*, CASE WHEN class = 'none' THEN 'none' WHEN class = 'queue' THEN 'queue'"
    " WHEN login NOT IN (SELECT login FROM users) THEN 'not_allowed'"
    " WHEN class = 'unsupported' THEN 'unsupported'"
    " WHEN EXISTS (SELECT 1 FROM jobs j WHERE j.repo = k.repo AND j.pr = k.pr"
    " AND j.comment_id = k.id) THEN 'duplicate' ELSE 'schedule' END AS disposition FROM keyed k)"
)
_ROUTE_CHAIN = (*_CHAIN, _USERS_CTE, _JOBS_CTE, _REPLIES_CTE, _ROUTED)
_META = (
    "texts AS (SELECT job, modified, list_transform(string_split(text, chr(10)),"
    " lambda l: trim(l)) AS ls FROM job_texts),\n"
    "meta AS (SELECT job, modified,"
    " coalesce(list_filter(list_transform(list_filter(ls, lambda l: starts_with(l, '# User:')),"
    " lambda l: trim(l[8:])), lambda u: u <> '')[-1], 'unknown') AS user,"
    " coalesce(list_transform(list_filter(ls, lambda l: starts_with(l, '# Comment:')),"
    " lambda l: trim(l[11:]))[-1], '') AS comment,"
    " list_filter(flatten(list_transform(ls, lambda l: string_split(CASE"
    " WHEN contains(l, 'BENCHMARKS=') THEN regexp_extract(l, 'BENCHMARKS=\"([^\"]+)\"', 1)"
    " WHEN contains(l, 'BENCH_NAME=') THEN regexp_extract(l, 'BENCH_NAME=\"([^\"]+)\"', 1)"
    " ELSE '' END, ' '))), lambda b: b <> '') AS benchmarks,"
    " list_transform(list_filter(ls, lambda l: starts_with(l, 'export ') AND contains(l, '=')),"
    " lambda l: trim(l[8:])) AS env FROM texts)"
)
_TEXTS_CTE = derived_cte("job_texts", _JOB_TEXTS, "events", lf="chr(10)")

_SQL = {
    "tri_window": over_comments(
        "SELECT repo, id, updated_at FROM comments"
        f" WHERE updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL {SECONDS} SECOND"
    ),
    "tri_window_limit": over_comments(
        "SELECT repo, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY repo"
        " ORDER BY updated_at DESC, id DESC) AS rn FROM comments"
        f" WHERE updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL {SECONDS} SECOND) WHERE rn <= {LIMIT}"
    ),
    "tri_split": over_comments(
        "SELECT id, first AS trigger, array_to_string(ls[2:], '|') AS rest FROM split",
        _TRIMMED,
        _SPLIT,
    ),
    "tri_classify": over_comments("SELECT id, class FROM classed", *_CHAIN),
    "tri_names": over_comments("SELECT id, array_to_string(names, ',') AS names FROM named", *_CHAIN),
    "tri_allowed_names": over_comments(
        "SELECT id, repo, len(names) > 0"
        " AND list_has_all(['tpch', 'tpch_mem', 'sql_planner'], names) AS allowed FROM named",
        *_CHAIN,
    ),
    "tri_bad_names": over_comments(
        "SELECT id, CASE WHEN class = 'unsupported' THEN array_to_string(list_filter("
        "string_split_regex(first, '\\s+')[3:], lambda w: NOT list_contains("
        "['tpch', 'tpch_mem', 'sql_planner'], w)), ',') ELSE '' END AS bad_names FROM classed",
        *_CHAIN,
    ),
    "tri_env": over_comments("SELECT id, array_to_string(env, ',') AS env FROM named", *_CHAIN),
    "tri_allowed_user": over_comments(
        "SELECT id, login, login IN (SELECT login FROM users) AS user_allowed FROM comments",
        _USERS_CTE,
    ),
    "tri_pr_number": over_comments("SELECT id, pr FROM split", _TRIMMED, _SPLIT),
    "tri_dedupe": over_comments(
        "SELECT repo, pr, id FROM classed c WHERE NOT EXISTS (SELECT 1 FROM jobs j"
        " WHERE j.repo = c.repo AND j.pr = c.pr AND j.comment_id = c.id)",
        *_CHAIN,
        _JOBS_CTE,
    ),
    "tri_already_replied": over_comments(
        "SELECT id, pr, id IN (SELECT id FROM replied) AS replied FROM classed", *_ROUTE_CHAIN
    ),
    "tri_route": over_comments(
        "SELECT id, disposition, disposition IN ('queue', 'not_allowed', 'unsupported')"
        " AND id NOT IN (SELECT id FROM replied) AS reply_due FROM decided",
        *_ROUTE_CHAIN,
    ),
    "tri_job_rows": over_comments(
        "SELECT job, id AS comment_id, CAST(position - 1 AS INTEGER) AS position, CASE"
        " WHEN name = 'default' THEN 'default'"
        " WHEN repo = 'org/b' OR name = 'sql_planner' THEN 'micro' ELSE 'suite' END AS kind, name,"
        " CASE WHEN name <> 'default' AND (repo = 'org/b' OR name = 'sql_planner')"
        " THEN 'compare-micro' ELSE 'compare-suite' END AS command,"
        " array_to_string(env, ',') AS env FROM (SELECT *, unnest(run) AS name,"
        " generate_subscripts(run, 1) AS position FROM (SELECT *, CASE WHEN class = 'default'"
        " THEN ['default'] ELSE names END AS run FROM decided WHERE disposition = 'schedule'))",
        *_ROUTE_CHAIN,
    ),
    "tri_job_key": over_comments("SELECT id, job FROM keyed", *_CHAIN),
    "tri_job_meta": (
        f"WITH {_TEXTS_CTE},\n{_META} SELECT job, user, comment,"
        " array_to_string(benchmarks, ',') AS benchmarks, array_to_string(env, ',') AS env FROM meta"
    ),
    "tri_queue": (
        f"WITH {_TEXTS_CTE},\n{_META} SELECT job, user, CASE WHEN len(benchmarks) > 0"
        " THEN array_to_string(benchmarks, ' ') ELSE 'default' END || CASE WHEN len(env) > 0"
        " THEN ' (env: ' || array_to_string(env, ' ') || ')' ELSE '' END AS benchmarks,"
        " CASE WHEN comment <> '' THEN comment ELSE 'unknown' END AS comment, modified"
        " FROM meta ORDER BY modified, job"
    ),
    "tri_stream": over_comments(
        "SELECT id, disposition, disposition IN ('queue', 'not_allowed', 'unsupported')"
        " AND id NOT IN (SELECT id FROM replied) AS reply_due FROM decided",
        *_ROUTE_CHAIN,
    ),
}


def queries():
    return {name: globals()[f"_{name}"] for name in _SQL}


def oracle_sql():
    return dict(_SQL)
