"""The suite by other ways: as SQL text, from a catalog table, and from summaries that merge.

Each query gives the rows of the operator it stands for, so the oracle SQL is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmill.operators import daily, heavy, histograms, web
from hitmill.plans import regress
from hitmill.plans import web as plans
from hitmill.plans.shape import result
from hitmill.plans.tables import hits, results
from hitmill.sources import catalog, signatures
from hitmill.sources.hits import load_hits, write_hits
from hitmill.sql_text import SqlText
from hitmill.staging import new_path, stage

# Statements in the dialect of the suite, with the derived table's constants as parameters.
STATEMENTS = {
    "sql_regions": (
        "cb_q9",
        'SELECT "RegionID", SUM("AdvEngineID") AS sum_adv, COUNT(*) AS c, AVG("ResolutionWidth") AS avg_width,'
        ' COUNT(DISTINCT "UserID") AS u FROM \'hits\' GROUP BY "RegionID" ORDER BY c DESC, 1 LIMIT 10;',
        {},
    ),
    "sql_minutes": (
        "cb_q18",
        'SELECT "UserID", extract(minute FROM to_timestamp_seconds("EventTime")) AS m, "SearchPhrase", COUNT(*) AS c'
        ' FROM hits GROUP BY "UserID", m, "SearchPhrase" ORDER BY COUNT(*) DESC, 1, 2, 3 LIMIT 10',
        {},
    ),
    "sql_hosts": (
        "cb_q28",
        "SELECT REGEXP_REPLACE(\"Referer\", '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS k,"
        ' AVG(length("Referer")) AS l, COUNT(*) AS c, MIN("Referer") AS min_referer FROM hits'
        " WHERE \"Referer\" <> '' GROUP BY k HAVING COUNT(*) > :more ORDER BY l DESC, k LIMIT 25",
        {"more": 100},
    ),
    "sql_variance": (
        "ext_q3",
        'SELECT "SocialSourceNetworkID", "RegionID", COUNT(*) AS c, AVG("Age") AS avg_age, AVG("ParamPrice") AS avg_price,'
        ' STDDEV("ParamPrice") AS s, VAR("ParamPrice") AS v FROM hits GROUP BY 1, 2'
        " HAVING s IS NOT NULL ORDER BY s DESC, 1, 2 LIMIT 10",
        {},
    ),
    "sql_tail": (
        "ext_q5",
        'SELECT "ClientIP", "WatchID", COUNT(*) c, MIN("ResponseStartTiming") tmin,'
        ' APPROX_PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY "ResponseStartTiming") tp95,'
        ' MAX("ResponseStartTiming") tmax FROM \'hits\' WHERE "JavaEnable" = 0 GROUP BY "ClientIP", "WatchID"'
        " HAVING c > 1 ORDER BY tp95 DESC NULLS LAST, 1, 2 LIMIT 10",
        {},
    ),
    "sql_funnel": (
        "ext_q6",
        'SELECT COUNT(*) AS ShareCount FROM hits WHERE "IsMobile" = 1 AND "MobilePhoneModel" LIKE \'iPhone%\''
        " AND \"SocialAction\" = 'share' AND \"SocialSourceNetworkID\" IN (5, 12) AND \"ClientTimeZone\" BETWEEN -5 AND 5"
        " AND regexp_match(\"Referer\", '/campaign/(spring|summer)_promo') IS NOT NULL"
        " AND CASE WHEN split_part(split_part(\"URL\", 'resolution=', 2), '&', 1) ~ '^\\d+$'"
        " THEN split_part(split_part(\"URL\", 'resolution=', 2), '&', 1)::INT ELSE 0 END > 1920"
        ' AND levenshtein(CAST("UTMSource" AS STRING), CAST("UTMCampaign" AS STRING)) < 3',
        {},
    ),
}


def _statement(name: str):
    _, text, parameters = STATEMENTS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result(SqlText(spark, hits=hits(spark, sf_dir)).run(text, **parameters))

    return query


def _src_catalog_days(spark, sf_dir):
    """Page views of one counter from a catalog table that knows its days."""
    rows = hits(spark, sf_dir)
    path, name = new_path(spark, "hits"), f"hits_{new_path(spark, 'days').rsplit('-', 1)[1]}"
    write_hits(rows, path, {"UserID": 100_000})
    days = catalog.register_hits(spark, path, rows.schema, name)
    catalog.analyze(spark, name, ["CounterID", "UserID"])
    return result(web.cb_q36(days, **plans.MONTH))


def _src_catalog_users(spark, sf_dir):
    """The busiest users from a table in buckets of users, without a shuffle."""
    path = new_path(spark, "users")
    users = catalog.write_bucketed(hits(spark, sf_dir), path, f"users_{path.rsplit('-', 1)[1]}", 8)
    return web.cb_q15(users)


def _src_file_signatures(spark, sf_dir):
    """A substring count over the files that may hold the text."""
    rows = hits(spark, sf_dir)
    path = new_path(spark, "hits")
    write_hits(rows, path)
    signed = stage(signatures.file_signatures(spark, path, "URL"), "signatures")
    return web.cb_q20(signatures.load_hits_with(spark, path, signed, "blog"), needle="blog")


def _daily_tails(spark, sf_dir):
    """The tail of response times from sketches of each day."""
    timed = hits(spark, sf_dir).where(F.col("JavaEnable") == 0)
    tails = daily.merged_tail(stage(daily.tail_sketches(timed), "sketches"))
    return tails.withColumn("tp95", F.col("tp95").cast("int"))


def _numbered(rows: DataFrame, value: str) -> DataFrame:
    """All values numbered in two batches, by days."""
    days = [rows.where(F.dayofmonth("EventDate") % 2 == i).select(F.col(value).alias("value")) for i in (0, 1)]
    first = stage(daily.number_values(days[0]), "numbers")
    return first.unionByName(stage(daily.number_values(days[1], first), "numbers"))


def _daily_users(spark, sf_dir):
    rows = hits(spark, sf_dir)
    return daily.distinct_counts(stage(daily.daily_bitmaps(rows, _numbered(rows, "UserID"), "UserID"), "bitmaps"))


def _daily_region_users(spark, sf_dir):
    rows = hits(spark, sf_dir)
    bitmaps = stage(daily.daily_bitmaps(rows, _numbered(rows, "UserID"), "UserID", ["RegionID"]), "bitmaps")
    counts = daily.distinct_counts(bitmaps, ["RegionID"])
    return counts.orderBy(F.desc("u"), "RegionID").limit(10)


def _heavy_phrases(spark, sf_dir):
    return heavy.top_counts(hits(spark, sf_dir), ["SearchPhrase"], where=F.col("SearchPhrase") != "")


def _heavy_users(spark, sf_dir):
    return heavy.top_counts(hits(spark, sf_dir), ["UserID"])


def _heavy_user_phrases(spark, sf_dir):
    return heavy.top_counts(hits(spark, sf_dir), ["UserID", "SearchPhrase"])


def _heavy_urls(spark, sf_dir):
    return heavy.top_counts(hits(spark, sf_dir), ["URL"])


def _updated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after two appends, a removal, and the same runs once more."""
    runs = results(spark, sf_dir)
    early = runs.where(F.col("git_revision_timestamp") < "2025-03-10")
    late = runs.where(F.col("git_revision_timestamp") >= "2025-03-10")
    one = runs.where(F.col("git_revision") == "r5")
    stored = stage(histograms.merged(histograms.value_counts(early), histograms.value_counts(late)), "counts")
    removed = stage(histograms.merged(stored, histograms.value_counts(one, -1)), "counts")
    return stage(histograms.merged(removed, histograms.value_counts(one)), "counts")


def _updated_baseline(spark, sf_dir):
    return result(histograms.baseline(_updated_counts(spark, sf_dir)), None)


def _updated_trend(spark, sf_dir):
    return result(histograms.trend(histograms.normalize(_updated_counts(spark, sf_dir))))


def _updated_per_query(spark, sf_dir):
    return result(histograms.per_query(histograms.normalize(_updated_counts(spark, sf_dir))))


# Query -> the query whose rows it gives.
SAME = {
    **{name: same for name, (same, _, _) in STATEMENTS.items()},
    "src_catalog_days": "cb_q36",
    "src_catalog_users": "cb_q15",
    "src_file_signatures": "cb_q20",
    "daily_tails": "ext_q5",
    "daily_users": "cb_q4",
    "daily_region_users": "cb_q8",
    "heavy_phrases": "cb_q12",
    "heavy_users": "cb_q15",
    "heavy_user_phrases": "cb_q16",
    "heavy_urls": "cb_q33",
    "updated_baseline": "reg_baseline",
    "updated_trend": "reg_trend",
    "updated_per_query": "reg_per_query",
}


def queries():
    return {name: _statement(name) if name in STATEMENTS else globals()[f"_{name}"] for name in SAME}


def oracle_sql():
    known = {**plans.oracle_sql(), **regress.oracle_sql()}
    return {name: known[same] for name, same in SAME.items()}
