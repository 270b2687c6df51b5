"""Rules of the web-analytics operators that the oracle does not show."""

from datetime import date

from pyspark.sql import functions as F

from hitmill.functions.sums import shifted_sums
from hitmill.functions.text import digits_or_zero, link_host, link_parameter
from hitmill.operators import web, web_extended
from hitmill.plans.tables import hits, hits_view


def test_shifted_sums_skip_nulls_and_keep_empty(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x smallint")
    assert tuple(shifted_sums(df, "x", range(3)).first()) == (6, 8, 10)
    assert tuple(shifted_sums(df.where("x > 9"), "x", range(2)).first()) == (None, None)
    plain = df.agg(*[F.sum(F.col("x") + k).alias(f"s{k}") for k in range(3)]).first()
    assert tuple(plain) == (6, 8, 10)


def test_link_host(spark):
    links = ["http://www.a.b/c", "https://a.b/", "http://a.b", "ftp://a.b/c", "", "https://www.x/y/z"]
    df = spark.createDataFrame([(u,) for u in links], "u string")
    got = [r[0] for r in df.select(link_host("u")).collect()]
    assert got == ["a.b", "a.b", "http://a.b", "ftp://a.b/c", "", "x"]


def test_link_parameter_and_digits(spark):
    links = ["/?resolution=1920&a=1", "/?resolution=12x", "/none", "/?resolution=99999999999", "/?resolution="]
    df = spark.createDataFrame([(u,) for u in links], "u string")
    got = [r[0] for r in df.select(digits_or_zero(link_parameter("u", "resolution="))).collect()]
    assert got == [1920, 0, 0, None, 0]


def test_default_constants_run(spark, sf_dir):
    table = hits(spark, sf_dir)
    for module, names in ((web, [f"cb_q{i}" for i in range(43)]), (web_extended, [f"ext_q{i}" for i in range(8)])):
        for name in names:
            assert getattr(module, name)(table).schema


def test_wide_lookup_equals_one_pass(spark, sf_dir):
    table = hits(spark, sf_dir)
    for k in (1, 10, 10_000_000):
        got = web.cb_q23(table, "blog", k)
        matching = table.where(F.col("URL").contains("blog"))
        rest = [F.asc_nulls_last(n) for n in table.columns if n != "EventTime"]
        want = matching.orderBy(F.asc_nulls_last("EventTime"), *rest).limit(k)
        assert got.collect() == want.collect()
    assert web.cb_q23(table, "no such text").collect() == []


def test_unordered_groups(spark, sf_dir):
    table = hits(spark, sf_dir)
    some = web.cb_q17(table, stable=False)
    every = web.count_by(table, "UserID", "SearchPhrase")
    assert some.count() == 10
    assert some.join(every, ["UserID", "SearchPhrase", "c"], "left_anti").isEmpty()


def test_offset_past_the_end(spark, sf_dir):
    got = web.cb_q41(hits(spark, sf_dir), first=date(2024, 1, 1), last=date(2024, 1, 31), url_hash=0)
    assert got.collect() == []


def test_exact_tail_interpolates(spark, sf_dir):
    table = hits(spark, sf_dir)
    exact = {(r.ClientIP, r.WatchID): r.tp95 for r in web_extended.ext_q5(table, 10**6, exact=True).collect()}
    own = table.where("JavaEnable = 0").groupBy("ClientIP", "WatchID").agg(
        F.count(F.lit(1)).alias("c"), F.percentile("ResponseStartTiming", web_extended.TAIL).alias("p")
    )
    split = {(r.ClientIP, r.WatchID): r.p for r in own.where("c > 1").collect()}
    sketch = {(r.ClientIP, r.WatchID): r.tp95 for r in web_extended.ext_q5(table, 10**6).collect()}
    assert exact.keys() == split.keys() == sketch.keys() and exact
    assert exact == split
    assert all((exact[k] is None) == (sketch[k] is None) for k in exact)


def test_stored_table_equals_view(spark, sf_dir):
    stored, view = hits(spark, sf_dir), hits_view(spark, sf_dir)
    assert dict(stored.dtypes) == dict(view.dtypes)
    aligned = stored.select(*view.columns)
    assert aligned.exceptAll(view).isEmpty() and view.exceptAll(aligned).isEmpty()
