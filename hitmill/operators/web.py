"""The web-analytics suite over the wide ``hits`` table.

Every function takes the table and returns a lazy DataFrame. Constants are
parameters with the suite's published values as defaults. Where the suite leaves
the order of ties open, the remaining output columns break them, so that results
are the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmill.functions.ordering import down, top, up
from hitmill.functions.sums import shifted_sums
from hitmill.functions.text import link_host

# The constants of the published suite.
POINT_USER = 435090932899640449
NEEDLE = "google"
TITLE_NEEDLE = "Google"
EXCLUDED_HOST = ".google."
HAVING_MORE_THAN = 100000
COUNTER = 62
FIRST_DAY = date(2013, 7, 1)
LAST_DAY = date(2013, 7, 31)
MINUTES_FIRST_DAY = date(2013, 7, 14)
MINUTES_LAST_DAY = date(2013, 7, 15)
TRAFFIC_SOURCES = (-1, 6)
REFERER_HASH = 3594120000172545465
URL_HASH = 2868770270353813622


def rows() -> Column:
    return F.count(F.lit(1))


def not_empty(name: str) -> Column:
    """Text columns use the empty text for "missing"."""
    return F.col(name) != ""


def count_by(hits: DataFrame, *keys: str, name: str = "c") -> DataFrame:
    return hits.groupBy(*keys).agg(rows().alias(name))


def users_by(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count_distinct("UserID").alias("u"))


# --- whole-table aggregates -------------------------------------------------


def cb_q0(hits: DataFrame) -> DataFrame:
    """Row count."""
    return hits.agg(rows().alias("c"))


def cb_q1(hits: DataFrame) -> DataFrame:
    """Rows that came from an advertising engine."""
    return hits.where(F.col("AdvEngineID") != 0).agg(rows().alias("c"))


def cb_q2(hits: DataFrame) -> DataFrame:
    """SUM, COUNT and AVG in one pass."""
    return hits.agg(
        F.sum("AdvEngineID").alias("sum_adv"),
        rows().alias("c"),
        F.avg("ResolutionWidth").alias("avg_width"),
    )


def cb_q3(hits: DataFrame) -> DataFrame:
    """Mean of a 64-bit id."""
    return hits.agg(F.avg("UserID").alias("avg_user"))


def cb_q4(hits: DataFrame) -> DataFrame:
    """Exact distinct users: two-level aggregation on the id, no hot task."""
    return hits.agg(F.count_distinct("UserID").alias("u"))


def cb_q5(hits: DataFrame) -> DataFrame:
    """Exact distinct search phrases."""
    return hits.agg(F.count_distinct("SearchPhrase").alias("u"))


def cb_q6(hits: DataFrame) -> DataFrame:
    """First and last day."""
    return hits.agg(F.min("EventDate").alias("first_day"), F.max("EventDate").alias("last_day"))


def cb_q7(hits: DataFrame) -> DataFrame:
    """Hits per advertising engine, all groups, most first."""
    ads = hits.where(F.col("AdvEngineID") != 0)
    return count_by(ads, "AdvEngineID").orderBy(down("c"), up("AdvEngineID"))


# --- top groups -------------------------------------------------------------


def cb_q8(hits: DataFrame, k: int = 10) -> DataFrame:
    """Distinct users per region."""
    return top(users_by(hits, "RegionID"), k, down("u"), up("RegionID"))


def cb_q9(hits: DataFrame, k: int = 10) -> DataFrame:
    """SUM, COUNT, AVG and a distinct count per region in one pass.

    The first shuffle is on (region, user), so a region that holds a third of
    all rows is spread over all tasks.
    """
    per_region = hits.groupBy("RegionID").agg(
        F.sum("AdvEngineID").alias("sum_adv"),
        rows().alias("c"),
        F.avg("ResolutionWidth").alias("avg_width"),
        F.count_distinct("UserID").alias("u"),
    )
    return top(per_region, k, down("c"), up("RegionID"))


def cb_q10(hits: DataFrame, k: int = 10) -> DataFrame:
    """Distinct users per phone model."""
    phones = hits.where(not_empty("MobilePhoneModel"))
    return top(users_by(phones, "MobilePhoneModel"), k, down("u"), up("MobilePhoneModel"))


def cb_q11(hits: DataFrame, k: int = 10) -> DataFrame:
    """Distinct users per phone and model."""
    phones = hits.where(not_empty("MobilePhoneModel"))
    keys = ("MobilePhone", "MobilePhoneModel")
    return top(users_by(phones, *keys), k, down("u"), *map(up, keys))


def cb_q12(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent search phrases."""
    phrases = count_by(hits.where(not_empty("SearchPhrase")), "SearchPhrase")
    return top(phrases, k, down("c"), up("SearchPhrase"))


def cb_q13(hits: DataFrame, k: int = 10) -> DataFrame:
    """Search phrases by distinct users."""
    phrases = users_by(hits.where(not_empty("SearchPhrase")), "SearchPhrase")
    return top(phrases, k, down("u"), up("SearchPhrase"))


def cb_q14(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent (engine, phrase) pairs."""
    keys = ("SearchEngineID", "SearchPhrase")
    return top(count_by(hits.where(not_empty("SearchPhrase")), *keys), k, down("c"), *map(up, keys))


def cb_q15(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most active users."""
    return top(count_by(hits, "UserID"), k, down("c"), up("UserID"))


def cb_q16(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent (user, phrase) pairs."""
    keys = ("UserID", "SearchPhrase")
    return top(count_by(hits, *keys), k, down("c"), *map(up, keys))


def cb_q17(hits: DataFrame, k: int = 10, stable: bool = True) -> DataFrame:
    """Any ``k`` (user, phrase) groups.

    The suite asks for no order. ``stable`` takes the first groups by key, which
    is one valid answer and the same on every run; without it Spark may stop as
    soon as it has ``k`` groups.
    """
    keys = ("UserID", "SearchPhrase")
    groups = count_by(hits, *keys)
    return top(groups, k, *map(up, keys)) if stable else groups.limit(k)


def cb_q18(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent (user, minute of the hour, phrase) groups."""
    timed = hits.select(
        "UserID", F.minute(F.timestamp_seconds("EventTime")).alias("m"), "SearchPhrase"
    )
    keys = ("UserID", "m", "SearchPhrase")
    return top(count_by(timed, *keys), k, down("c"), *map(up, keys))


# --- lookups and text search ------------------------------------------------


def cb_q19(hits: DataFrame, user_id: int = POINT_USER) -> DataFrame:
    """Point lookup; the equality reaches the Parquet scan."""
    return hits.where(F.col("UserID") == user_id).select("UserID")


def cb_q20(hits: DataFrame, needle: str = NEEDLE) -> DataFrame:
    """Hits whose URL contains a text."""
    return hits.where(F.col("URL").contains(needle)).agg(rows().alias("c"))


def cb_q21(hits: DataFrame, needle: str = NEEDLE, k: int = 10) -> DataFrame:
    """Phrases that led to matching URLs."""
    matching = hits.where(F.col("URL").contains(needle) & not_empty("SearchPhrase"))
    phrases = matching.groupBy("SearchPhrase").agg(F.min("URL").alias("min_url"), rows().alias("c"))
    return top(phrases, k, down("c"), up("SearchPhrase"))


def cb_q22(
    hits: DataFrame,
    title: str = TITLE_NEEDLE,
    excluded: str = EXCLUDED_HOST,
    k: int = 10,
) -> DataFrame:
    """Phrases by title match, with URLs of one host left out."""
    matching = hits.where(
        F.col("Title").contains(title)
        & ~F.col("URL").contains(excluded)
        & not_empty("SearchPhrase")
    )
    phrases = matching.groupBy("SearchPhrase").agg(
        F.min("URL").alias("min_url"),
        F.min("Title").alias("min_title"),
        rows().alias("c"),
        F.count_distinct("UserID").alias("u"),
    )
    return top(phrases, k, down("c"), up("SearchPhrase"))


def cb_q23(hits: DataFrame, needle: str = NEEDLE, k: int = 10) -> DataFrame:
    """The earliest matching rows with all columns.

    Two passes, so that the wide columns of all matches need not be read: a scan
    of two columns finds the time of the k-th match, and the wide scan gets that
    time as a pushed-down filter that skips all later row groups. Ties at that
    time are kept until the final top-k, so the result is exact.
    """
    matching = hits.where(F.col("URL").contains(needle))
    earliest = top(matching.select("EventTime"), k, up("EventTime"))
    threshold = earliest.agg(F.max("EventTime")).scalar()
    wide = matching.where(F.col("EventTime") <= threshold)
    rest = [name for name in hits.columns if name != "EventTime"]
    return top(wide, k, up("EventTime"), *map(up, rest))


def cb_q24(hits: DataFrame, k: int = 10) -> DataFrame:
    """Phrases in time order (the time itself is not in the result)."""
    phrases = hits.where(not_empty("SearchPhrase")).select("SearchPhrase", "EventTime")
    return top(phrases, k, up("EventTime"), up("SearchPhrase")).select("SearchPhrase")


def cb_q25(hits: DataFrame, k: int = 10) -> DataFrame:
    """Phrases in text order, repeats kept."""
    phrases = hits.where(not_empty("SearchPhrase")).select("SearchPhrase")
    return top(phrases, k, up("SearchPhrase"))


def cb_q26(hits: DataFrame, k: int = 10) -> DataFrame:
    """Phrases in time order, ties in text order."""
    phrases = hits.where(not_empty("SearchPhrase")).select("SearchPhrase", "EventTime")
    return top(phrases, k, up("EventTime"), up("SearchPhrase")).select("SearchPhrase")


def cb_q27(hits: DataFrame, more_than: int = HAVING_MORE_THAN, k: int = 25) -> DataFrame:
    """Counters by mean URL length, busy counters only."""
    lengths = (
        hits.where(not_empty("URL"))
        .groupBy("CounterID")
        .agg(F.avg(F.length("URL")).alias("l"), rows().alias("c"))
    )
    return top(lengths.where(F.col("c") > more_than), k, down("l"), up("CounterID"))


def cb_q28(hits: DataFrame, more_than: int = HAVING_MORE_THAN, k: int = 25) -> DataFrame:
    """Referring hosts by mean referer length, busy hosts only."""
    hosts = (
        hits.where(not_empty("Referer"))
        .groupBy(link_host("Referer").alias("k"))
        .agg(
            F.avg(F.length("Referer")).alias("l"),
            rows().alias("c"),
            F.min("Referer").alias("min_referer"),
        )
    )
    return top(hosts.where(F.col("c") > more_than), k, down("l"), up("k"))


def cb_q29(hits: DataFrame, shifts: Sequence[int] = range(90)) -> DataFrame:
    """90 shifted sums from one SUM and one COUNT."""
    return shifted_sums(hits, "ResolutionWidth", shifts)


# --- wide groupings ---------------------------------------------------------


def _visits(hits: DataFrame, *keys: str, k: int) -> DataFrame:
    visits = hits.groupBy(*keys).agg(
        rows().alias("c"),
        F.sum("IsRefresh").alias("refreshes"),
        F.avg("ResolutionWidth").alias("avg_width"),
    )
    return top(visits, k, down("c"), *map(up, keys))


def cb_q30(hits: DataFrame, k: int = 10) -> DataFrame:
    """Visits per (engine, address) of searches."""
    return _visits(hits.where(not_empty("SearchPhrase")), "SearchEngineID", "ClientIP", k=k)


def cb_q31(hits: DataFrame, k: int = 10) -> DataFrame:
    """Visits per (watch, address) of searches; nearly one group per row."""
    return _visits(hits.where(not_empty("SearchPhrase")), "WatchID", "ClientIP", k=k)


def cb_q32(hits: DataFrame, k: int = 10) -> DataFrame:
    """Visits per (watch, address) over all rows, the largest group state."""
    return _visits(hits, "WatchID", "ClientIP", k=k)


def cb_q33(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most requested URLs."""
    return top(count_by(hits, "URL"), k, down("c"), up("URL"))


def cb_q34(hits: DataFrame, k: int = 10) -> DataFrame:
    """Most requested URLs beside a constant key; the constant is not shuffled."""
    urls = count_by(hits, "URL").select(F.lit(1).alias("one"), "URL", "c")
    return top(urls, k, down("c"), up("URL"))


def cb_q35(hits: DataFrame, k: int = 10) -> DataFrame:
    """Addresses with values derived from them.

    The derived columns depend on the address alone, so only the address is a
    group key; the rest is computed for the ``k`` result rows.
    """
    addresses = top(count_by(hits, "ClientIP"), k, down("c"), up("ClientIP"))
    ip = F.col("ClientIP").cast("bigint")
    return addresses.select(
        "ClientIP", *[(ip - n).alias(f"ip_minus_{n}") for n in (1, 2, 3)], "c"
    )


# --- one counter's page views -----------------------------------------------


def _counter_days(hits: DataFrame, counter: int, first: date, last: date) -> DataFrame:
    """Rows of one counter in a range of days, without page refreshes."""
    return hits.where(
        (F.col("CounterID") == counter)
        & F.col("EventDate").between(F.lit(first), F.lit(last))
        & (F.col("IsRefresh") == 0)
    )


def _page_views(hits: DataFrame, *keys: str, k: int, offset: int = 0) -> DataFrame:
    views = count_by(hits, *keys, name="PageViews")
    return top(views, k, down("PageViews"), *map(up, keys), offset=offset)


def cb_q36(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = FIRST_DAY,
    last: date = LAST_DAY,
    k: int = 10,
) -> DataFrame:
    """Page views per URL."""
    counted = _counter_days(hits, counter, first, last).where(F.col("DontCountHits") == 0)
    return _page_views(counted.where(not_empty("URL")), "URL", k=k)


def cb_q37(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = FIRST_DAY,
    last: date = LAST_DAY,
    k: int = 10,
) -> DataFrame:
    """Page views per title."""
    counted = _counter_days(hits, counter, first, last).where(F.col("DontCountHits") == 0)
    return _page_views(counted.where(not_empty("Title")), "Title", k=k)


def cb_q38(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = FIRST_DAY,
    last: date = LAST_DAY,
    k: int = 10,
    offset: int = 1000,
) -> DataFrame:
    """Page views of links that are no downloads."""
    links = _counter_days(hits, counter, first, last).where(
        (F.col("IsLink") != 0) & (F.col("IsDownload") == 0)
    )
    return _page_views(links, "URL", k=k, offset=offset)


def cb_q39(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = FIRST_DAY,
    last: date = LAST_DAY,
    k: int = 10,
    offset: int = 1000,
) -> DataFrame:
    """Page views per traffic source, source page and target page."""
    direct = (F.col("SearchEngineID") == 0) & (F.col("AdvEngineID") == 0)
    moves = _counter_days(hits, counter, first, last).select(
        "TraficSourceID",
        "SearchEngineID",
        "AdvEngineID",
        F.when(direct, F.col("Referer")).otherwise("").alias("Src"),
        F.col("URL").alias("Dst"),
    )
    return _page_views(moves, *moves.columns, k=k, offset=offset)


def cb_q40(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = FIRST_DAY,
    last: date = LAST_DAY,
    sources: Sequence[int] = TRAFFIC_SOURCES,
    referer_hash: int = REFERER_HASH,
    k: int = 10,
    offset: int = 100,
) -> DataFrame:
    """Page views per URL hash and day for one referer."""
    referred = _counter_days(hits, counter, first, last).where(
        F.col("TraficSourceID").isin(*sources) & (F.col("RefererHash") == referer_hash)
    )
    return _page_views(referred, "URLHash", "EventDate", k=k, offset=offset)


def cb_q41(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = FIRST_DAY,
    last: date = LAST_DAY,
    url_hash: int = URL_HASH,
    k: int = 10,
    offset: int = 10000,
) -> DataFrame:
    """Page views per window size for one URL."""
    sized = _counter_days(hits, counter, first, last).where(
        (F.col("DontCountHits") == 0) & (F.col("URLHash") == url_hash)
    )
    return _page_views(sized, "WindowClientWidth", "WindowClientHeight", k=k, offset=offset)


def cb_q42(
    hits: DataFrame,
    counter: int = COUNTER,
    first: date = MINUTES_FIRST_DAY,
    last: date = MINUTES_LAST_DAY,
    k: int = 10,
    offset: int = 1000,
) -> DataFrame:
    """Page views per minute in time order."""
    minute = F.date_trunc("minute", F.timestamp_seconds("EventTime")).cast("timestamp_ntz")
    counted = _counter_days(hits, counter, first, last).where(F.col("DontCountHits") == 0)
    views = counted.groupBy(minute.alias("M")).agg(rows().alias("PageViews"))
    return top(views, k, up("M"), offset=offset)
