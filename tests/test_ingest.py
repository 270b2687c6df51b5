"""Rules of ingestion and history."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hitmill import ingestion
from hitmill.ingestion import append_new_revisions, stored_results
from hitmill.operators import history, ingest
from hitmill.sources.results import RESULTS_SCHEMA


def test_new_revisions_reads_all_stored_rows(spark):
    row = ("b", "q", "query", 1.0, "t")
    batch = spark.createDataFrame([(*row, r, "t", 1) for r in ("a", "b", "c", "")], RESULTS_SCHEMA)
    stored = spark.createDataFrame([(*row, r, "t", 1) for r in ("a", "b", "b", "")], RESULTS_SCHEMA)
    got = sorted(r.git_revision for r in ingest.new_revisions(batch, stored).collect())
    assert got == ["", "c"]


def test_expected_runs(spark):
    rows = [("b", "q1", "query", 1.0, "t", "a", "t", 1)] * 5 + [("b", "q1", "table_creation", 1.0, "t", "a", "t", 1)]
    rows += [("b", "q2", "query", 1.0, "t", "a", "t", 1)] * 4
    table = spark.createDataFrame(rows, RESULTS_SCHEMA)
    listed = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q3",)], "query_name string")
    got = {r.query_name: (r.git_revision, r.runs, r.complete) for r in ingest.expected_runs(table, listed).collect()}
    assert got == {"q1": ("a", 5, True), "q2": ("a", 4, False), "q3": (None, 0, False)}


def test_artifacts(spark):
    names = spark.createDataFrame(
        [("tool@a@t1",), ("tool@b",), ("tool",), ("other@c@t",), ("tool@d@t@more",)], "name string"
    )
    got = {r.name: (r.version, r.timestamp) for r in ingest.parse_artifacts(names).collect()}
    assert got["tool@a@t1"] == ("a", "t1") and got["tool@d@t@more"] == ("d", "t")
    assert got["tool@b"] == got["tool"] == ("unknown", "unknown")
    picked = lambda pattern: sorted(r.name for r in ingest.select_artifacts(names, pattern).collect())
    assert picked("tool@*") == ["tool@a@t1", "tool@b", "tool@d@t@more"]
    assert picked("*@[bc]*") == ["other@c@t", "tool@b"]
    assert picked("tool@?") == ["tool@b"]


def test_missing_builds(spark):
    commits = spark.createDataFrame(
        [(c, datetime(2025, 1, d, 12), "u") for c, d in (("a", 1), ("b", 9), ("c", 10), ("d", 11))],
        "revision string, time timestamp, url string",
    )
    names = spark.createDataFrame([("tool@c",), ("other@b@t",), ("tool",)], "name string")
    got = ingest.missing_builds(commits, names, date(2025, 1, 11), 2, "tool").collect()
    assert sorted(r.revision for r in got) == ["b", "d"]
    window = ingest.commit_window(commits, date(2025, 1, 11), 2).collect()
    assert [r.revision for r in window] == ["b", "c", "d"]


def test_build_summary(spark):
    outcomes = spark.createDataFrame([(True,), (True,), (False,)], "ok boolean")
    assert tuple(ingest.build_summary(outcomes).first()) == (2, 1, 3)


def commits(spark):
    rows = [
        ("a", datetime(2025, 1, 1, 8)),
        ("b", datetime(2025, 1, 1, 23, 59)),
        ("c", datetime(2025, 1, 1, 23, 59)),
        ("c", datetime(2025, 1, 1, 1)),
        ("d", datetime(2025, 1, 2)),
    ]
    return spark.createDataFrame(rows, "revision string, time timestamp").withColumn("url", F.lit("u"))


def test_daily_pick(spark):
    picks = history.daily_pick(commits(spark)).collect()
    assert [(r.revision, r.day.day) for r in picks] == [("d", 2), ("c", 1)]
    repeats = history.daily_pick(commits(spark), keep_repeats=True).collect()
    assert [(r.revision, r.time.hour) for r in repeats] == [("d", 0), ("c", 23), ("c", 1)]


def test_other_bucket_widths(spark):
    hours = history.with_bucket(commits(spark), "6 hours").collect()
    assert sorted(r.day.hour for r in hours) == [0, 0, 6, 18, 18]


def test_command_rows(spark):
    got = [r.command for r in history.command_rows(commits(spark), "./build.sh").collect()]
    assert got == ["./build.sh d", "./build.sh c", "./build.sh b", "./build.sh a", "./build.sh c"]


def test_appends_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "results")
    row = ("b", "q", "query", 1.0, "t")
    first = spark.createDataFrame([(*row, r, "t", 1) for r in ("a", "a", "b")], RESULTS_SCHEMA)
    more = spark.createDataFrame([(*row, r, "t", 1) for r in ("b", "c")], RESULTS_SCHEMA)
    assert stored_results(spark, path) is None
    for batch in (first, first, more, more):
        append_new_revisions(batch, path)
    got = sorted(r.git_revision for r in stored_results(spark, path).collect())
    assert got == ["a", "a", "b", "c"]


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_a_broken_append_leaves_nothing_behind(spark, tmp_path, monkeypatch, form):
    path = str(tmp_path / "results")
    row = ("b", "q", "query", 1.0, "t")
    first = spark.createDataFrame([(*row, r, "t", 1) for r in ("a", "b")], RESULTS_SCHEMA)
    more = spark.createDataFrame([(*row, r, "t", 1) for r in ("b", "c", "c", "d")], RESULTS_SCHEMA)
    assert append_new_revisions(first, path, form)

    # Broken before the entry: all files are there, none is read.
    publish = ingestion._Files.publish
    monkeypatch.setattr(ingestion._Files, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        append_new_revisions(more, path, form)
    monkeypatch.setattr(ingestion._Files, "publish", publish)
    assert sorted(r.git_revision for r in stored_results(spark, path, form).collect()) == ["a", "b"]

    # Broken while the files were written.
    broken = more.withColumn("num_cores", F.when(F.col("git_revision") == "d", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("num_cores")))
    with pytest.raises(Exception):
        append_new_revisions(broken, path, form)
    assert append_new_revisions(more, path, form)
    assert not append_new_revisions(more, path, form)
    assert sorted(r.git_revision for r in stored_results(spark, path, form).collect()) == ["a", "b", "c", "c", "d"]


def test_of_two_appends_at_a_time_one_looks_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    row = ("b", "q", "query", 1.0, "t")
    one, other = (spark.createDataFrame([(*row, r, "t", 1) for r in rs], RESULTS_SCHEMA) for rs in (("a", "b"), ("b", "c")))
    append, write = ingestion.append_results, []

    def slow(rows, folder, form):
        append(rows, folder, form)
        if not write:
            write.append(folder)
            assert append_new_revisions(one, path, "parquet")

    monkeypatch.setattr(ingestion, "append_results", slow)
    assert append_new_revisions(other, path, "parquet")
    assert sorted(r.git_revision for r in stored_results(spark, path, "parquet").collect()) == ["a", "b", "c"]
