"""Files and row groups that a query can leave out."""

import pytest
from pyspark.sql import functions as F

from hitmill.sources import signatures
from hitmill.sources.hits import load_hits, write_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("signed") / "hits")
    words = ["alpha", "beta", "gamma", "日本語", None, ""]
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 6).cast("int"))
    url = F.get(F.array(*map(F.lit, words)), (F.col("id") % 6).cast("int"))
    spark.range(600).select(day.alias("EventDate"), F.lit(1).alias("CounterID"), F.col("id").alias("EventTime"), F.concat(url, F.lit("/x")).alias("URL")).write.partitionBy("EventDate").parquet(path)
    return path


@pytest.mark.parametrize("needle, days", [("alph", 1), ("a/x", 3), ("gam", 1), ("日本語", 1), ("zzz", 0), ("mma/x", 1), ("a", 6), ("/x", 6), ("", 6)])
def test_files_are_left_out_and_no_row_is_lost(spark, folder, needle, days):
    signed = signatures.file_signatures(spark, folder, "URL")
    rows = signatures.load_hits_with(spark, folder, signed, needle)
    want = load_hits(spark, folder).where(F.col("URL").contains(needle))
    assert rows.where(F.col("URL").contains(needle)).exceptAll(want).isEmpty()
    assert want.exceptAll(rows.where(F.col("URL").contains(needle))).isEmpty()
    assert rows.columns == want.columns
    files = signatures.files_with(signed, needle)
    folders = {r.file.split("EventDate=")[1].split("/")[0] for r in files.collect()}
    assert len(folders) == days


def rows_read(df):
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def test_point_lookups_read_fewer_row_groups(spark, tmp_path):
    """Many users over the whole range in every file: neither ranges nor dictionaries can tell."""
    rows = spark.range(40_000, numPartitions=4).select(
        F.lit("2024-01-01").cast("date").alias("EventDate"), F.lit(1).alias("CounterID"), F.col("id").alias("EventTime"),
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) * 2).alias("UserID"),
    )
    old = {k: spark.conf.get(k, None) for k in ("parquet.enable.dictionary",)}
    spark.conf.set("parquet.enable.dictionary", "false")
    try:
        plain, bloom = str(tmp_path / "plain"), str(tmp_path / "bloom")
        write_hits(rows, plain)
        write_hits(rows, bloom, {"UserID": 40_000})
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    there = rows.first().UserID
    for user, least in ((there, 1), (there + 1, 0)):
        reads = [rows_read(load_hits(spark, path).where(F.col("UserID") == user).select("UserID")) for path in (plain, bloom)]
        assert reads[0] == 40_000 and (reads[1] == 0 if not least else reads[1] >= 1), reads
        found = load_hits(spark, bloom).where(F.col("UserID") == user)
        assert found.count() == rows.where(F.col("UserID") == user).count()
