"""Hits as a table of the catalog."""

import re

import pytest
from pyspark.sql import functions as F
from test_plans import plan

from hitmill.operators import web
from hitmill.plans.tables import HITS_COLUMNS, hits
from hitmill.plans.web import PARAMETERS
from hitmill.sources import catalog


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The hits directory of the queries as an external table, and the same rows in buckets."""
    rows = hits(spark, sf_dir)
    folder = rows.inputFiles()[0].split("/EventDate=")[0]
    days = catalog.register_hits(spark, folder, rows.schema, "hits_by_day")
    users = catalog.write_bucketed(rows, str(tmp_path_factory.mktemp("users")), "hits_by_user", 8)
    yield days, users
    spark.sql("DROP TABLE hits_by_day")
    spark.sql("DROP TABLE hits_by_user")


def test_same_rows(spark, sf_dir, stored):
    rows = hits(spark, sf_dir).select(*HITS_COLUMNS)
    for table in stored:
        assert table.select(*HITS_COLUMNS).exceptAll(rows).isEmpty()
        assert rows.exceptAll(table.select(*HITS_COLUMNS)).isEmpty()


def test_users_are_counted_without_a_shuffle(spark, sf_dir, stored):
    _, users = stored
    text = plan(web.cb_q15(users))
    assert "Exchange" not in text and "TakeOrderedAndProject" in text
    assert "Exchange" in plan(web.cb_q15(hits(spark, sf_dir)))
    assert web.cb_q15(users).collect() == web.cb_q15(hits(spark, sf_dir)).collect()


def test_joins_by_user_need_no_shuffle(spark, stored):
    _, users = stored
    one = users.groupBy("UserID").agg(F.count("*").alias("c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(users.join(one, "UserID").select("UserID", "c", "RegionID"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text


def scanned_folders(df):
    """Folders that the scan of a finished query has read, by its metrics."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if hasattr(node, "executedPlan") and node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numPartitions").value()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def test_days_are_read_by_name(spark, sf_dir, stored):
    days, _ = stored
    query = web.cb_q36(days, **PARAMETERS["cb_q36"])
    text = plan(query)
    found = re.search(r"PartitionFilters: \[(.*)\]", text)
    assert found and "EventDate" in found.group(1)
    assert scanned_folders(query) == days.where(F.col("EventDate").between(*PARAMETERS["cb_q36"].values())).select("EventDate").distinct().count()
    one = days.where(F.col("EventDate") == PARAMETERS["cb_q36"]["first"]).groupBy("RegionID").count()
    assert scanned_folders(one) == 1 < scanned_folders(days.groupBy("RegionID").count())
    assert query.collect() == web.cb_q36(hits(spark, sf_dir), **PARAMETERS["cb_q36"]).collect()


def test_statistics(spark, stored):
    days, _ = stored
    catalog.analyze(spark, "hits_by_day", ["UserID", "CounterID"])
    rows = {r.info_name: r.info_value for r in spark.sql("DESCRIBE EXTENDED hits_by_day CounterID").collect()}
    assert rows["distinct_count"].isdigit() and int(rows["distinct_count"]) > 0 and "histogram" in rows
    day = days.select("EventDate").first()[0]
    about = spark.sql(f"DESCRIBE EXTENDED hits_by_day PARTITION (EventDate = '{day}')").collect()
    assert any(r.col_name == "Partition Statistics" and "rows" in r.data_type for r in about)


def test_days_come_and_go(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "UserID long, EventDate string").withColumn("EventDate", F.to_date("EventDate"))
    rows.where("UserID = 1").write.partitionBy("EventDate").parquet(path)
    table = catalog.register_hits(spark, path, rows.schema, "few_hits")
    try:
        assert table.count() == 1
        rows.where("UserID = 2").write.mode("append").partitionBy("EventDate").parquet(path)
        assert spark.table("few_hits").count() == 1
        catalog.refresh_days(spark, "few_hits")
        assert spark.table("few_hits").count() == 2
    finally:
        spark.sql("DROP TABLE few_hits")
