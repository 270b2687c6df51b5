"""The request language, routing and the streaming job."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hitmill.operators import triage
from hitmill.operators.triage import RepoRules
from hitmill.plans import triage as plans
from hitmill.plans.tables import comments as stored_comments
from hitmill.sources.allow_lists import published_rules
from hitmill.sources.comments import COMMENTS_SCHEMA, stream_comments, stream_records
from hitmill.streaming import triage as streaming

NOON = datetime(2025, 1, 1, 12)
RULES = (
    RepoRules("org/a", suites=("tpch", "tpch_mem"), micro=("sql_planner", "json-reader")),
    RepoRules("org/b", micro=("take_kernels",), key_prefix="b-"),
)


def comments(spark, rows):
    """Rows of dicts with some of the fields."""
    base = {
        "id": 1, "repo": "org/a", "login": "ann", "body": "", "html_url": "https://x/1",
        "issue_url": "https://api/issues/7", "created_at": NOON, "updated_at": NOON,
    }
    full = [tuple({**base, "id": i + 1, **row}.values()) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, COMMENTS_SCHEMA)


CASES = [
    ("run benchmarks", "default", [], []),
    ("\n\t run benchmarks \r\n", "default", [], []),
    ("RUN  BENCHMARKS\n\nA=1\n b_=2\n_B1=x.y-z_ \nC=\nD=a b", "default", [], ["A=1", "_B1=x.y-z_"]),
    ("run benchmarks now", "unsupported", [], []),
    ("run benchmark", "unsupported", [], []),
    ("run benchmark tpch", "named", ["tpch"], []),
    ("run benchmark json-reader tpch tpch", "named", ["json-reader", "tpch", "tpch"], []),
    ("run\tbenchmark tpch A=1", "named", ["tpch"], ["A=1"]),
    ("run benchmark tpch\x0bA=1\x85B=2\x1cC=3", "named", ["tpch"], ["A=1", "B=2", "C=3"]),
    ("run benchmark TPCH", "unsupported", [], []),
    ("run benchmark tpch; rm", "unsupported", [], []),
    ("run benchmark tpch,tpch_mem", "unsupported", [], []),
    ("run  benchmark nosuch", "none", [], []),
    ("run  benchmark tpch", "named", ["tpch"], []),
    ("run benchmarking", "unsupported", [], []),
    ("please run benchmark tpch", "none", [], []),
    ("hello\nrun benchmarks", "none", [], []),
    ("  Show Benchmark QUEUE\n", "queue", [], []),
    ("show benchmark queue\nnow", "none", [], []),
    ("show  benchmark queue", "none", [], []),
    ("", "none", [], []),
    (" \n ", "none", [], []),
    (None, "none", [], []),
    ("run benchmark take_kernels", "unsupported", [], []),
]


def test_classes_names_and_settings(spark):
    table = comments(spark, [{"body": case[0]} for case in CASES])
    got = triage.classify(table, RULES).orderBy("id").collect()
    for row, (body, kind, names, env) in zip(got, CASES, strict=True):
        assert (row["class"], row.names, row.env) == (kind, names, env), repr(body)


def test_very_long_trigger(spark):
    body = "run benchmark " + "tpch " * 20000 + "\nA=1"
    row = triage.classify(comments(spark, [{"body": body}]), RULES).first()
    assert row["class"] == "named" and len(row.names) == 20000 and row.env == ["A=1"]


def test_bad_names_keep_order_and_repeats(spark):
    table = comments(spark, [{"body": "run benchmark x tpch y x"}, {"body": "run benchmarks z tpch"}])
    got = triage.classify(table, RULES).orderBy("id").collect()
    assert [r.bad_names for r in got] == [["x", "y", "x"], ["z"]]


def test_rules_differ_by_repository(spark):
    table = comments(
        spark, [{"repo": repo, "body": "run benchmark take_kernels"} for repo in ("org/b", "org/a", "org/c")]
    )
    got = triage.classify(table, RULES).orderBy("id").collect()
    assert [r["class"] for r in got] == ["named", "unsupported", "unsupported"]


def test_pr_number(spark):
    urls = ["https://api/issues/19000", "https://api/issues/5//", "", None, "plain"]
    got = triage.classify(comments(spark, [{"issue_url": u} for u in urls]), RULES).orderBy("id").collect()
    assert [r.pr for r in got] == ["19000", "5", "", "", "plain"]


def test_recent(spark):
    rows = [{"repo": "org/a", "updated_at": NOON - timedelta(minutes=i)} for i in range(150)]
    rows += [{"repo": "org/b", "updated_at": NOON - timedelta(minutes=59 + i)} for i in range(4)]
    got = triage.recent(comments(spark, rows), NOON, limit=50).groupBy("repo").count().collect()
    assert {r.repo: r["count"] for r in got} == {"org/a": 50, "org/b": 2}
    assert triage.recent(comments(spark, rows), NOON).count() == 61 + 2
    same = comments(spark, [{"updated_at": NOON}] * 80)
    assert sorted(r.id for r in triage.recent(same, NOON, limit=50).collect()) == list(range(31, 81))


def _contains(urls, bodies):
    return {u for u in urls if any(u in (b or "") for b in bodies)}


def test_replied_is_a_substring_test(spark):
    urls = [
        "https://x/1", "https://x/12", "https://x/3", "x/4", "", "https://x/r?to=https://y/5",
        "odd text", "https://x/é6", "http", "https://x/none",
    ]
    bodies = ["see https://x/12.", "(https://x/3)https://x/é67", "ax/4b", None, "odd textile",
              "https://x/r?to=https://y/55", ""]
    table = comments(spark, [{"html_url": u} for u in urls])
    classed = triage.classify(table, RULES)
    replies = spark.createDataFrame([("org/a", "7", b) for b in bodies], "repo string, pr string, body string")
    got = triage.with_reply(classed, replies).where("replied").collect()
    assert {r.html_url for r in got} == _contains(urls, bodies)
    for other in (replies.withColumn("pr", F.lit("8")), replies.withColumn("repo", F.lit("org/b"))):
        assert triage.with_reply(classed, other).where("replied").isEmpty()


def test_a_busy_pr_makes_no_pairs(spark):
    """4000 comments and 4000 replies of one PR: pieces grow with the text only."""
    table = comments(spark, [{"html_url": f"https://x/{i}"} for i in range(4000)])
    replies = spark.range(4000).select(
        F.lit("org/a").alias("repo"), F.lit("7").alias("pr"),
        F.concat(F.lit("re https://x/"), F.col("id") * 2, F.lit(" ok")).alias("body"),
    )
    classed = triage.classify(table, RULES)
    assert triage.mentioned_links(replies, classed).count() < 4 * 4000
    links = {f"https://x/{i * 2}" for i in range(4000)}
    want = {u for u in (f"https://x/{i}" for i in range(4000)) if any(l.startswith(u) for l in links)}
    got = {r.html_url for r in triage.with_reply(classed, replies).where("replied").collect()}
    assert got == want


def test_route(spark):
    rows = [
        {"body": "show benchmark queue", "login": "eve"},
        {"body": "nice"},
        {"body": "run benchmark nosuch", "login": "eve"},
        {"body": "run benchmark nosuch"},
        {"body": "run benchmarks", "login": "eve"},
        {"body": "run benchmarks"},
        {"body": "run benchmarks"},
        {"body": "run benchmarks", "issue_url": ""},
        {"body": "run benchmarks", "repo": "org/c"},
        {"body": "run benchmark nosuch", "html_url": "https://x/answered"},
    ]
    users = spark.createDataFrame([("ann",), ("ann",)], "login string")
    jobs = spark.createDataFrame([("org/a", "7", 6)] * 2, "repo string, pr string, comment_id bigint")
    replies = spark.createDataFrame(
        [("org/a", "7", "Hi, (https://x/answered)")], "repo string, pr string, body string"
    )
    got = triage.route(comments(spark, rows), RULES, users, jobs, replies).orderBy("id").collect()
    assert [(r.disposition, r.reply_due) for r in got] == [
        ("queue", True),
        ("none", False),
        ("not_allowed", True),
        ("unsupported", True),
        ("not_allowed", True),
        ("duplicate", False),
        ("schedule", False),
        ("none", False),
        ("none", False),
        ("unsupported", False),
    ]


def test_job_rows(spark):
    rows = [
        {"body": "run benchmark sql_planner tpch\nA=1"},
        {"body": "run benchmarks"},
        {"body": "run benchmark take_kernels", "repo": "org/b"},
        {"body": "nothing"},
    ]
    got = triage.job_rows(triage.classify(comments(spark, rows), RULES), RULES)
    got = got.orderBy("comment_id", "position").collect()
    assert [(r.job, r.kind, r.name, r.command, r.env) for r in got] == [
        ("7_1", "micro", "sql_planner", "compare-micro", ["A=1"]),
        ("7_1", "suite", "tpch", "compare-suite", ["A=1"]),
        ("7_2", "default", "default", "compare-suite", []),
        ("b-7-3", "micro", "take_kernels", "compare-micro", []),
    ]


def test_job_meta_and_queue(spark):
    texts = [
        "# Comment: https://x/1\r\n# User: ann\r\n\r\nexport A=1\r\nBENCHMARKS=\"tpch tpch10\" ./run\r\nBENCH_NAME=\"sort\" ./run",
        "./run",
        "# User: \n# User: bob : x\n# Comment: old\n# Comment:\nexport =\nexport B\n"
        "  export C=3  \nBENCHMARKS=tpch\necho BENCH_NAME=\"left\"",
    ]
    jobs = spark.createDataFrame(
        [(f"{i}.sh", NOON - timedelta(hours=i), t) for i, t in enumerate(texts)],
        "job string, modified timestamp, text string",
    )
    meta = triage.job_meta(jobs)
    got = {r.job: (r.user, r.comment, r.benchmarks, r.env) for r in meta.collect()}
    assert got == {
        "0.sh": ("ann", "https://x/1", ["tpch", "tpch10", "sort"], ["A=1"]),
        "1.sh": ("unknown", "", [], []),
        "2.sh": ("bob : x", "", ["left"], ["=", "C=3"]),
    }
    rows = triage.queue(meta).collect()
    assert [(r.job, r.user, r.benchmarks, r.comment) for r in rows] == [
        ("2.sh", "bob : x", "left (env: = C=3)", "unknown"),
        ("1.sh", "unknown", "default", "unknown"),
        ("0.sh", "ann", "tpch tpch10 sort (env: A=1)", "https://x/1"),
    ]


def test_stream_equals_batch(spark, sf_dir):
    batch = plans.queries()["tri_route"](spark, sf_dir)
    stream = plans.queries()["tri_stream"](spark, sf_dir)
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()


def test_stream_takes_edits_and_late_rows_and_resumes(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    users = spark.createDataFrame([("ann",)], "login string")

    def poll(rows):
        comments(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = stream_comments(spark, folder)
        streaming.route_batches(stream, out, checkpoint, RULES, lambda _: users).awaitTermination()
        jobs = streaming.scheduled_jobs(streaming.decided(spark, out), RULES)
        return sorted((r.comment_id, r.name) for r in jobs.collect())

    first = {"id": 10, "body": "run benchmark tpch sql_planner"}
    wrong = {"id": 12, "body": "run benchmark tpchh"}
    have = [(10, "sql_planner"), (10, "tpch")]
    assert poll([first, first, wrong]) == have
    again = {**first, "updated_at": NOON + timedelta(minutes=5)}
    second = {"id": 11, "body": "run benchmarks", "updated_at": NOON + timedelta(hours=6)}
    right = {"id": 12, "body": "run benchmark tpch", "updated_at": NOON + timedelta(minutes=5)}
    have += [(11, "default"), (12, "tpch")]
    assert poll([again, second, right]) == have
    late = {"id": 13, "body": "run benchmarks", "updated_at": NOON - timedelta(days=2)}
    assert poll([late, wrong, first, second]) == [*have, (13, "default")]
    newest = {r.id: r.disposition for r in streaming.dispositions(spark, out).collect()}
    assert newest == {10: "duplicate", 11: "schedule", 12: "schedule", 13: "schedule"}


def test_stream_of_json_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    record = {"id": 5, "body": "run benchmarks\nA=1", "user": {"login": "ann"},
              "issue_url": "https://api/issues/7", "updated_at": "2025-01-01T12:00:00Z"}
    (folder / "1.json").write_text(json.dumps(record) + "\n" + json.dumps(record) + "\n")
    users = spark.createDataFrame([("ann",)], "login string")
    out = str(tmp_path / "out")
    records = stream_records(spark, str(folder), "org/a")
    streaming.route_batches(records, out, str(tmp_path / "check"), RULES, lambda _: users).awaitTermination()
    got = streaming.scheduled_jobs(streaming.decided(spark, out), RULES).collect()
    assert [(r.job, r.kind, r.env) for r in got] == [("7_5", "default", ["A=1"])]


@pytest.mark.parametrize("name", ["tri_classify", "tri_env", "tri_names"])
def test_one_pass_without_shuffle(spark, sf_dir, name):
    text = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_published_rules(spark):
    rules = published_rules("org/engine", "org/library", "lib-")
    bodies = [("org/engine", "tpcds sort"), ("org/library", "json-reader json_reader"), ("org/library", "tpcds")]
    table = comments(spark, [{"repo": r, "body": f"run benchmark {names}"} for r, names in bodies])
    classed = triage.classify(table, rules)
    assert [r["class"] for r in classed.orderBy("id").collect()] == ["named", "named", "unsupported"]
    got = triage.job_rows(classed, rules).orderBy("comment_id", "position").collect()
    assert [(r.job, r.kind, r.command) for r in got] == [
        ("7_1", "suite", "compare-suite"),
        ("7_1", "micro", "compare-micro"),
        ("lib-7-2", "micro", "compare-library"),
        ("lib-7-2", "micro", "compare-library"),
    ]


def test_stream_batches_do_not_read_earlier_decisions(spark, tmp_path, monkeypatch):
    """New comments and repeats need the state alone, whatever the number of earlier batches."""
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    users = spark.createDataFrame([("ann",)], "login string")
    read, decided = [], streaming.decided
    monkeypatch.setattr(streaming, "decided", lambda *args: read.append(args) or decided(*args))

    def poll(rows):
        comments(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = stream_comments(spark, folder)
        streaming.route_batches(stream, out, checkpoint, RULES, lambda _: users).awaitTermination()

    for i in range(6):
        poll([{"id": 100 + j, "body": "run benchmarks"} for j in range(i + 1)])
    assert not read
    stored = decided(spark, out)
    assert stored.count() == 6 and {r.disposition for r in stored.collect()} == {"schedule"}
    poll([{"id": 100, "body": "run benchmarks", "updated_at": NOON + timedelta(minutes=1)}])
    assert len(read) == 1
    assert {(r.id, r.disposition) for r in streaming.dispositions(spark, out).collect()} == {(100, "duplicate"), *((101 + j, "schedule") for j in range(5))}


def test_stream_state_keeps_the_newest_version(spark, tmp_path):
    """Outdated versions do not come out again, nor do ties of the same time that came later."""
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "check"))
    users = spark.createDataFrame([("ann",)], "login string")

    def poll(rows):
        comments(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        streaming.route_batches(stream_comments(spark, folder), out, checkpoint, RULES, lambda _: users).awaitTermination()

    later = NOON + timedelta(hours=1)
    poll([{"id": 1, "body": "run benchmarks", "updated_at": later}])
    poll([{"id": 1, "body": "nothing"}, {"id": 2, "body": "nothing"}])
    poll([{"id": 1, "body": "nothing at all", "updated_at": later}, {"id": 2, "body": "run benchmarks", "updated_at": later}])
    got = sorted((r.id, r.disposition, r.batch) for r in streaming.decided(spark, out).collect())
    assert got == [(1, "schedule", 0), (2, "none", 1), (2, "schedule", 2)]
