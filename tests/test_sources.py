"""Files in and out."""

import json

import pytest

from pyspark.sql import functions as F

from hitmill.operators.ingest import extract_timings, label_runs
from hitmill.plans.tables import hits_view
from hitmill.sources.comments import load_comments
from hitmill.sources.commits import load_adhoc_csv, load_commits
from hitmill.sources.hits import load_hits, write_hits
from hitmill.sources.jobs import load_jobs
from hitmill.sources.labels import last_labels, load_labels
from hitmill.sources.logs import load_logs, load_names
from hitmill.sources.results import RESULTS_COLUMNS, append_results, load_results


def test_hits_binary_text_and_day_numbers(spark, tmp_path):
    spark.range(3).select(
        F.lit(19723).alias("EventDate"),
        F.encode(F.lit("äb"), "UTF-8").alias("URL"),
        F.col("id").alias("UserID"),
    ).write.parquet(str(tmp_path / "h"))
    table = load_hits(spark, str(tmp_path / "h"))
    assert dict(table.dtypes) == {"EventDate": "date", "URL": "string", "UserID": "bigint"}
    assert table.where("URL = 'äb' AND EventDate = DATE '2024-01-01'").count() == 3


def test_hits_dates_as_text(spark, tmp_path):
    spark.createDataFrame([("2024-01-02",)], "EventDate string").write.parquet(str(tmp_path / "h"))
    assert str(load_hits(spark, str(tmp_path / "h")).first()[0]) == "2024-01-02"


def test_write_hits_has_one_folder_per_day(spark, sf_dir, tmp_path):
    view = hits_view(spark, sf_dir)
    write_hits(view, str(tmp_path / "h"))
    folders = {p.name for p in (tmp_path / "h").iterdir() if p.is_dir()}
    days = {f"EventDate={r[0]}" for r in view.select("EventDate").distinct().collect()}
    assert folders == days


LOG = """DataSet ready
Elapsed 0.020 seconds.
+----+
| Elapsed |
Elapsed abc seconds.
Elapsed
  Elapsed   0.5e-1 seconds.
Elapsed 0.030 seconds.
x Elapsed 1
1 0.7 Elapsed
Elapsed 1d s
Elapsed 0x1p3 s
Elapsed 1..2 s
Elapsed .5E+1 s
"""


def test_log_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "q1.log").write_text(LOG)
    got = extract_timings(load_logs(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.execution_time for r in got] == [0.02, 0.05, 0.03, 0.7, 5.0]


def test_first_kept_line_is_the_creation_also_of_split_files(spark, tmp_path):
    for name in ("q1", "q2"):
        lines = "".join(f"Elapsed {i}.5 seconds.\nother {'x' * 50}\n" for i in range(5000))
        (tmp_path / f"{name}.log").write_text("Elapsed none seconds.\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        logs = load_logs(spark, str(tmp_path))
        assert logs.rdd.getNumPartitions() > 10
        name = F.regexp_extract("log", r"([^/]+)\.log$", 1)
        runs = label_runs(extract_timings(logs), name, "b", "t", None, None, 4).cache()
        assert runs.columns == RESULTS_COLUMNS
        first = runs.where("query_type = 'table_creation'").collect()
        assert sorted((r.query_name, r.execution_time) for r in first) == [("q1", 0.5), ("q2", 0.5)]
        assert runs.count() == 10000
        assert runs.first().git_revision == ""
        ordered = extract_timings(logs).where("log LIKE '%q1.log'").orderBy("line_no").collect()
        assert [r.execution_time for r in ordered] == [i + 0.5 for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_labels_last_duplicate_wins(spark, tmp_path):
    first = [{"revision": "a", "label": "1"}, {"revision": "b", "label": "2"}, {"revision": "a", "label": "3"}]
    (tmp_path / "1.json").write_text(json.dumps(first, indent=2))
    (tmp_path / "2.json").write_text(json.dumps([{"revision": "b", "label": "4", "PR": "p"}]))
    labels = load_labels(spark, str(tmp_path))
    assert labels.count() == 4
    got = {r.revision: (r.label, r.pr) for r in last_labels(labels).collect()}
    assert got == {"a": ("3", None), "b": ("4", "p")}


def test_results_append_and_read_back(spark, tmp_path):
    path = str(tmp_path / "results")
    row = ("b", "q1", "query", 0.25, "2025-01-01 00:00:00", "r1", "2025-01-01T00:00:00+08:00", 8)
    runs = spark.createDataFrame([row], RESULTS_COLUMNS)
    append_results(runs, path)
    append_results(runs.withColumn("git_revision", F.lit("")), path)
    back = load_results(spark, path + "/*.csv")
    assert back.columns == RESULTS_COLUMNS
    assert back.count() == 2
    assert tuple(back.where("git_revision = 'r1'").first()) == row
    append_results(runs, path + "-parquet", "parquet")
    assert tuple(spark.read.parquet(path + "-parquet").first()) == row


def test_plain_csv_of_other_tools(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        ",".join(RESULTS_COLUMNS) + "\nb,q0,query,0.023,2025-01-01 00:00:00,abc,2025-01-01T00:00:00+00:00,16\n"
    )
    got = load_results(spark, str(tmp_path / "*.csv")).first()
    assert (got.execution_time, got.num_cores, got.git_revision) == (0.023, 16, "abc")


def test_commits_csv(spark, tmp_path):
    path = tmp_path / "commits.csv"
    path.write_text("revision,time,url\nabc,2025-01-01 10:00:00 +0200,u1\ndef,2025-01-02 00:00:00 +0000,u2\n")
    adhoc = load_adhoc_csv(spark, str(path))
    assert adhoc.columns == ["revision", "time", "url"]
    assert adhoc.count() == 2
    times = [str(r.time) for r in load_commits(spark, str(path)).orderBy("revision").collect()]
    assert times == ["2025-01-01 08:00:00", "2025-01-02 00:00:00"]


def test_artifact_names_from_a_folder(spark, tmp_path):
    for name in ("tool@a@1", "tool@b@2", "other@c@3"):
        (tmp_path / name).write_bytes(b"x")
    got = load_names(spark, str(tmp_path), "tool@*").collect()
    assert sorted(r.name for r in got) == ["tool@a@1", "tool@b@2"]


def test_comment_records(spark, tmp_path):
    records = [
        {"id": 1, "body": "run benchmarks", "user": {"login": "u"}, "html_url": "h", "issue_url": "i/7",
         "created_at": "2025-01-01T00:00:00Z", "updated_at": "2025-01-01T00:00:00Z"},
        {"id": 2, "body": None, "user": None},
    ]
    (tmp_path / "c.json").write_text(json.dumps(records))
    got = load_comments(spark, str(tmp_path / "c.json"), "org/a", array_files=True).orderBy("id").collect()
    assert [(r.id, r.repo, r.login, r.body) for r in got] == [(1, "org/a", "u", "run benchmarks"), (2, "org/a", "", "")]


def test_pending_jobs_only(spark, tmp_path):
    (tmp_path / "1_2.sh").write_text("# User: me\n./run\n")
    (tmp_path / "1_3.sh.done").write_text("# User: me\n")
    got = load_jobs(spark, str(tmp_path)).collect()
    assert [r.job for r in got] == ["1_2.sh"]


def test_bad_input_is_not_lost(spark, tmp_path):
    swapped = [RESULTS_COLUMNS[1], RESULTS_COLUMNS[0], *RESULTS_COLUMNS[2:]]
    (tmp_path / "a.csv").write_text(",".join(swapped) + "\nq0,b,query,0.1,t,abc,t,16\n")
    (tmp_path / "b.csv").write_text(",".join(RESULTS_COLUMNS) + "\nb,q0,query,fast,t,abc,t,16\n")
    for name in ("a.csv", "b.csv"):
        with pytest.raises(Exception):
            load_results(spark, str(tmp_path / name)).collect()
    (tmp_path / "c.json").write_text('[{"revision": "a"')
    with pytest.raises(Exception):
        load_labels(spark, str(tmp_path / "c.json")).collect()
    with pytest.raises(Exception):
        load_comments(spark, str(tmp_path / "c.json"), "org/a").collect()
