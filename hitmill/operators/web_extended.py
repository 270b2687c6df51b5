"""The extended web-analytics suite: multi-distinct, spread, percentiles, funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.functions.ordering import down, top, up
from hitmill.functions.quantiles import group_median, group_percentile
from hitmill.functions.text import digits_or_zero, link_parameter
from hitmill.operators.web import rows

# The constants of the published suite.
PHONE_PREFIX = "iPhone"
SHARE_ACTION = "share"
SHARE_NETWORKS = (5, 12)
TIME_ZONES = (-5, 5)
CAMPAIGN_PATTERN = r"/campaign/(spring|summer)_promo"
RESOLUTION_MARKER = "resolution="
MIN_RESOLUTION = 1920
MAX_EDIT_DISTANCE = 3
TAIL = 0.95


def _distinct_counts(*names: str):
    return [F.count_distinct(name).alias(f"n_{name}") for name in names]


def ext_q0(hits: DataFrame) -> DataFrame:
    """Distinct phrases, phones and phone models."""
    return hits.agg(*_distinct_counts("SearchPhrase", "MobilePhone", "MobilePhoneModel"))


def ext_q1(hits: DataFrame) -> DataFrame:
    """Distinct colours, countries and languages."""
    return hits.agg(*_distinct_counts("HitColor", "BrowserCountry", "BrowserLanguage"))


def ext_q2(hits: DataFrame, k: int = 10) -> DataFrame:
    """Four distinct counts per country."""
    countries = hits.groupBy("BrowserCountry").agg(
        *_distinct_counts("SocialNetwork", "HitColor", "BrowserLanguage", "SocialAction")
    )
    return top(countries, k, down("n_SocialNetwork"), up("BrowserCountry"))


def ext_q3(hits: DataFrame, k: int = 10) -> DataFrame:
    """Sample deviation and variance of prices; groups of one price are left out."""
    keys = ("SocialSourceNetworkID", "RegionID")
    prices = hits.groupBy(*keys).agg(
        rows().alias("c"),
        F.avg("Age").alias("avg_age"),
        F.avg("ParamPrice").alias("avg_price"),
        F.stddev_samp("ParamPrice").alias("s"),
        F.var_samp("ParamPrice").alias("v"),
    )
    return top(prices.where(F.col("s").isNotNull()), k, down("s"), *map(up, keys))


def _timings():
    return [
        rows().alias("c"),
        F.min("ResponseStartTiming").alias("tmin"),
        F.max("ResponseStartTiming").alias("tmax"),
    ]


def _timed(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("JavaEnable") == 0).select("ClientIP", "WatchID", "ResponseStartTiming")


def ext_q4(hits: DataFrame, k: int = 10) -> DataFrame:
    """Exact median response per (address, watch)."""
    keys = ("ClientIP", "WatchID")
    medians = group_median(_timed(hits), keys, "ResponseStartTiming", _timings(), "tmed")
    return top(medians.where(F.col("c") > 1), k, down("tmed"), *map(up, keys))


def ext_q5(
    hits: DataFrame,
    k: int = 10,
    fraction: float = TAIL,
    accuracy: int = 10000,
    exact: bool = False,
) -> DataFrame:
    """Tail response per (address, watch).

    By default a mergeable sketch of bounded size per group, which returns a
    value that occurs; ``exact`` interpolates the true percentile.
    """
    keys = ("ClientIP", "WatchID")
    if exact:
        tails = group_percentile(
            _timed(hits), keys, "ResponseStartTiming", fraction, _timings(), "tp95"
        )
    else:
        tail = F.percentile_approx("ResponseStartTiming", fraction, accuracy)
        tails = _timed(hits).groupBy(*keys).agg(*_timings(), tail.alias("tp95"))
    return top(tails.where(F.col("c") > 1), k, down("tp95"), *map(up, keys))


def ext_q6(
    hits: DataFrame,
    phone_prefix: str = PHONE_PREFIX,
    action: str = SHARE_ACTION,
    networks: Sequence[int] = SHARE_NETWORKS,
    time_zones: tuple[int, int] = TIME_ZONES,
    campaign: str = CAMPAIGN_PATTERN,
    min_resolution: int = MIN_RESOLUTION,
    max_distance: int = MAX_EDIT_DISTANCE,
) -> DataFrame:
    """Shares that came through a campaign on a large screen.

    The cheap column predicates reach the scan; the text work is done on what
    they leave.
    """
    funnel = hits.where(
        (F.col("IsMobile") == 1)
        & F.col("MobilePhoneModel").startswith(phone_prefix)
        & (F.col("SocialAction") == action)
        & F.col("SocialSourceNetworkID").isin(*networks)
        & F.col("ClientTimeZone").between(*time_zones)
        & F.col("Referer").rlike(campaign)
        & (digits_or_zero(link_parameter("URL", RESOLUTION_MARKER)) > min_resolution)
        & (
            F.levenshtein(F.col("UTMSource").cast("string"), F.col("UTMCampaign").cast("string"))
            < max_distance
        )
    )
    return funnel.agg(rows().alias("ShareCount"))


def ext_q7(hits: DataFrame, k: int = 10) -> DataFrame:
    """Width range and refreshes per watch, highest watch ids."""
    watches = hits.groupBy("WatchID").agg(
        F.min("ResolutionWidth").alias("wmin"),
        F.max("ResolutionWidth").alias("wmax"),
        F.sum("IsRefresh").alias("srefresh"),
    )
    return top(watches, k, down("WatchID"))
