"""Properties of physical plans that matter on large tables."""

import re

import pytest

from hitmill.plans import registry
from hitmill.operators import regress
from hitmill.plans.tables import results

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"PythonUDF|ArrowEval|BatchEvalPython|MapInPandas", text)


@pytest.mark.parametrize(
    "name, part",
    [
        ("cb_q19", "EqualTo(UserID,41)"),
        ("cb_q20", "StringContains(URL,blog)"),
        ("cb_q23", "LessThanOrEqual(EventTime,ScalarSubquery"),
        ("cb_q36", "EqualTo(CounterID,62)"),
        ("ext_q6", "StringStartsWith(MobilePhoneModel,iPhone)"),
    ],
)
def test_filter_reaches_the_scan(spark, sf_dir, name, part):
    assert part in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["cb_q36", "cb_q38", "cb_q40", "cb_q42"])
def test_days_prune_partitions(spark, sf_dir, name):
    found = re.search(r"PartitionFilters: \[(.*)\]", plan(QUERIES[name](spark, sf_dir)))
    assert found and "EventDate" in found.group(1)


@pytest.mark.parametrize("name", ["cb_q9", "cb_q12", "cb_q32", "cb_q38", "ext_q2", "ext_q4"])
def test_top_k_needs_no_full_sort(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_pieces_of_a_busy_pr_are_spread(spark, sf_dir):
    text = plan(QUERIES["tri_already_replied"](spark, sf_dir))
    assert re.search(r"hashpartitioning\(_replied_repo#\d+, _replied_pr#\d+, _replied_link#\d+", text)


def test_medians_shuffle_on_all_keys(spark, sf_dir):
    """Also when the baseline is too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(regress.per_query(regress.normalize(results(spark, sf_dir))))
        assert "SortMergeJoin" in text
        keys = r"git_revision#\d+, git_revision_timestamp#\d+, query_name#\d+"
        assert re.search(rf"hashpartitioning\({keys}", text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_used_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["cb_q2"](spark, sf_dir))
    assert "ReadSchema: struct<AdvEngineID:smallint,ResolutionWidth:smallint>" in text


def test_wide_groups_are_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["tri_window_limit"](spark, sf_dir))
