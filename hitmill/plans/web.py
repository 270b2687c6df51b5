"""The web-analytics queries on the derived hits table, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from hitmill.operators import web, web_extended
from hitmill.plans.shape import result
from hitmill.plans.tables import HITS_COLUMNS, hits, over_hits

# The suite's own constants select nothing in the derived table; these do.
MONTH = {"first": date(2024, 1, 1), "last": date(2024, 1, 31)}
PARAMETERS: dict[str, dict] = {
    "cb_q19": {"user_id": 41},
    "cb_q20": {"needle": "blog"},
    "cb_q21": {"needle": "blog"},
    "cb_q22": {"title": "The", "excluded": ".blog."},
    "cb_q23": {"needle": "blog"},
    "cb_q27": {"more_than": 100},
    "cb_q28": {"more_than": 100},
    "cb_q36": MONTH,
    "cb_q37": MONTH,
    "cb_q38": {**MONTH, "offset": 10},
    "cb_q39": {**MONTH, "offset": 1000},
    "cb_q40": {**MONTH, "referer_hash": 4, "offset": 100},
    "cb_q41": {**MONTH, "url_hash": 0, "offset": 5},
    "cb_q42": {"first": date(2024, 1, 14), "last": date(2024, 1, 15), "offset": 10},
}

_COUNTER_DAYS = (
    "CounterID = 62 AND EventDate >= DATE '2024-01-01' AND EventDate <= DATE '2024-01-31'"
    " AND IsRefresh = 0"
)
_VISITS = (
    "count(*) AS c, CAST(sum(IsRefresh) AS BIGINT) AS refreshes,"
    " round(avg(ResolutionWidth), 6) AS avg_width FROM hits"
)
# All columns in table order break ties; EventDate is the folder column, so the last one.
_ALL_BY_TIME = ", ".join(
    f"{name} NULLS LAST"
    for name in [
        "EventTime",
        *[name for name in HITS_COLUMNS if name not in ("EventTime", "EventDate")],
        "EventDate",
    ]
)

_SQL = {
    "cb_q0": "SELECT count(*) AS c FROM hits",
    "cb_q1": "SELECT count(*) AS c FROM hits WHERE AdvEngineID <> 0",
    "cb_q2": (
        "SELECT CAST(sum(AdvEngineID) AS BIGINT) AS sum_adv, count(*) AS c,"
        " round(avg(ResolutionWidth), 6) AS avg_width FROM hits"
    ),
    "cb_q3": "SELECT round(avg(UserID), 6) AS avg_user FROM hits",
    "cb_q4": "SELECT count(DISTINCT UserID) AS u FROM hits",
    "cb_q5": "SELECT count(DISTINCT SearchPhrase) AS u FROM hits",
    "cb_q6": "SELECT min(EventDate) AS first_day, max(EventDate) AS last_day FROM hits",
    "cb_q7": (
        "SELECT AdvEngineID, count(*) AS c FROM hits WHERE AdvEngineID <> 0"
        " GROUP BY AdvEngineID ORDER BY c DESC, AdvEngineID"
    ),
    "cb_q8": (
        "SELECT RegionID, count(DISTINCT UserID) AS u FROM hits"
        " GROUP BY RegionID ORDER BY u DESC, RegionID LIMIT 10"
    ),
    "cb_q9": (
        "SELECT RegionID, CAST(sum(AdvEngineID) AS BIGINT) AS sum_adv, count(*) AS c,"
        " round(avg(ResolutionWidth), 6) AS avg_width, count(DISTINCT UserID) AS u"
        " FROM hits GROUP BY RegionID ORDER BY c DESC, RegionID LIMIT 10"
    ),
    "cb_q10": (
        "SELECT MobilePhoneModel, count(DISTINCT UserID) AS u FROM hits"
        " WHERE MobilePhoneModel <> '' GROUP BY MobilePhoneModel"
        " ORDER BY u DESC, MobilePhoneModel LIMIT 10"
    ),
    "cb_q11": (
        "SELECT MobilePhone, MobilePhoneModel, count(DISTINCT UserID) AS u FROM hits"
        " WHERE MobilePhoneModel <> '' GROUP BY MobilePhone, MobilePhoneModel"
        " ORDER BY u DESC, MobilePhone, MobilePhoneModel LIMIT 10"
    ),
    "cb_q12": (
        "SELECT SearchPhrase, count(*) AS c FROM hits WHERE SearchPhrase <> ''"
        " GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10"
    ),
    "cb_q13": (
        "SELECT SearchPhrase, count(DISTINCT UserID) AS u FROM hits WHERE SearchPhrase <> ''"
        " GROUP BY SearchPhrase ORDER BY u DESC, SearchPhrase LIMIT 10"
    ),
    "cb_q14": (
        "SELECT SearchEngineID, SearchPhrase, count(*) AS c FROM hits WHERE SearchPhrase <> ''"
        " GROUP BY SearchEngineID, SearchPhrase"
        " ORDER BY c DESC, SearchEngineID, SearchPhrase LIMIT 10"
    ),
    "cb_q15": (
        "SELECT UserID, count(*) AS c FROM hits GROUP BY UserID ORDER BY c DESC, UserID LIMIT 10"
    ),
    "cb_q16": (
        "SELECT UserID, SearchPhrase, count(*) AS c FROM hits GROUP BY UserID, SearchPhrase"
        " ORDER BY c DESC, UserID, SearchPhrase LIMIT 10"
    ),
    "cb_q17": (
        "SELECT UserID, SearchPhrase, count(*) AS c FROM hits GROUP BY UserID, SearchPhrase"
        " ORDER BY UserID, SearchPhrase LIMIT 10"
    ),
    "cb_q18": (
        "SELECT UserID, CAST(extract(minute FROM make_timestamp(EventTime * 1000000)) AS INTEGER)"
        " AS m, SearchPhrase, count(*) AS c FROM hits GROUP BY UserID, m, SearchPhrase"
        " ORDER BY c DESC, UserID, m, SearchPhrase LIMIT 10"
    ),
    "cb_q19": "SELECT UserID FROM hits WHERE UserID = 41",
    "cb_q20": "SELECT count(*) AS c FROM hits WHERE URL LIKE '%blog%'",
    "cb_q21": (
        "SELECT SearchPhrase, min(URL) AS min_url, count(*) AS c FROM hits"
        " WHERE URL LIKE '%blog%' AND SearchPhrase <> ''"
        " GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10"
    ),
    "cb_q22": (
        "SELECT SearchPhrase, min(URL) AS min_url, min(Title) AS min_title, count(*) AS c,"
        " count(DISTINCT UserID) AS u FROM hits"
        " WHERE Title LIKE '%The%' AND URL NOT LIKE '%.blog.%' AND SearchPhrase <> ''"
        " GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10"
    ),
    "cb_q23": f"SELECT * FROM hits WHERE URL LIKE '%blog%' ORDER BY {_ALL_BY_TIME} LIMIT 10",
    "cb_q24": (
        "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> ''"
        " ORDER BY EventTime, SearchPhrase LIMIT 10"
    ),
    "cb_q25": (
        "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY SearchPhrase LIMIT 10"
    ),
    "cb_q26": (
        "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> ''"
        " ORDER BY EventTime, SearchPhrase LIMIT 10"
    ),
    "cb_q27": (
        "SELECT CounterID, round(avg(length(URL)), 6) AS l, count(*) AS c FROM hits"
        " WHERE URL <> '' GROUP BY CounterID HAVING count(*) > 100"
        " ORDER BY avg(length(URL)) DESC, CounterID LIMIT 25"
    ),
    "cb_q28": (
        r"SELECT regexp_replace(Referer, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k,"
        " round(avg(length(Referer)), 6) AS l, count(*) AS c, min(Referer) AS min_referer"
        " FROM hits WHERE Referer <> '' GROUP BY k HAVING count(*) > 100"
        " ORDER BY avg(length(Referer)) DESC, k LIMIT 25"
    ),
    "cb_q29": (
        "SELECT "
        + ", ".join(f"CAST(sum(ResolutionWidth + {k}) AS BIGINT) AS s{k}" for k in range(90))
        + " FROM hits"
    ),
    "cb_q30": (
        f"SELECT SearchEngineID, ClientIP, {_VISITS} WHERE SearchPhrase <> ''"
        " GROUP BY SearchEngineID, ClientIP ORDER BY c DESC, SearchEngineID, ClientIP LIMIT 10"
    ),
    "cb_q31": (
        f"SELECT WatchID, ClientIP, {_VISITS} WHERE SearchPhrase <> ''"
        " GROUP BY WatchID, ClientIP ORDER BY c DESC, WatchID, ClientIP LIMIT 10"
    ),
    "cb_q32": (
        f"SELECT WatchID, ClientIP, {_VISITS}"
        " GROUP BY WatchID, ClientIP ORDER BY c DESC, WatchID, ClientIP LIMIT 10"
    ),
    "cb_q33": "SELECT URL, count(*) AS c FROM hits GROUP BY URL ORDER BY c DESC, URL LIMIT 10",
    "cb_q34": (
        "SELECT 1 AS one, URL, count(*) AS c FROM hits GROUP BY 1, URL ORDER BY c DESC, URL LIMIT 10"
    ),
    "cb_q35": (
        "SELECT ClientIP, CAST(ClientIP AS BIGINT) - 1 AS ip_minus_1,"
        " CAST(ClientIP AS BIGINT) - 2 AS ip_minus_2, CAST(ClientIP AS BIGINT) - 3 AS ip_minus_3,"
        " count(*) AS c FROM hits GROUP BY 1, 2, 3, 4 ORDER BY c DESC, ClientIP LIMIT 10"
    ),
    "cb_q36": (
        f"SELECT URL, count(*) AS PageViews FROM hits WHERE {_COUNTER_DAYS} AND DontCountHits = 0"
        " AND URL <> '' GROUP BY URL ORDER BY PageViews DESC, URL LIMIT 10"
    ),
    "cb_q37": (
        f"SELECT Title, count(*) AS PageViews FROM hits WHERE {_COUNTER_DAYS}"
        " AND DontCountHits = 0 AND Title <> ''"
        " GROUP BY Title ORDER BY PageViews DESC, Title LIMIT 10"
    ),
    "cb_q38": (
        f"SELECT URL, count(*) AS PageViews FROM hits WHERE {_COUNTER_DAYS} AND IsLink <> 0"
        " AND IsDownload = 0 GROUP BY URL ORDER BY PageViews DESC, URL LIMIT 10 OFFSET 10"
    ),
    "cb_q39": (
        "SELECT TraficSourceID, SearchEngineID, AdvEngineID,"
        " CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 THEN Referer ELSE '' END AS Src,"
        f" URL AS Dst, count(*) AS PageViews FROM hits WHERE {_COUNTER_DAYS}"
        " GROUP BY TraficSourceID, SearchEngineID, AdvEngineID, Src, Dst"
        " ORDER BY PageViews DESC, TraficSourceID, SearchEngineID, AdvEngineID, Src, Dst"
        " LIMIT 10 OFFSET 1000"
    ),
    "cb_q40": (
        f"SELECT URLHash, EventDate, count(*) AS PageViews FROM hits WHERE {_COUNTER_DAYS}"
        " AND TraficSourceID IN (-1, 6) AND RefererHash = 4 GROUP BY URLHash, EventDate"
        " ORDER BY PageViews DESC, URLHash, EventDate LIMIT 10 OFFSET 100"
    ),
    "cb_q41": (
        "SELECT WindowClientWidth, WindowClientHeight, count(*) AS PageViews FROM hits"
        f" WHERE {_COUNTER_DAYS} AND DontCountHits = 0 AND URLHash = 0"
        " GROUP BY WindowClientWidth, WindowClientHeight"
        " ORDER BY PageViews DESC, WindowClientWidth, WindowClientHeight LIMIT 10 OFFSET 5"
    ),
    "cb_q42": (
        "SELECT date_trunc('minute', make_timestamp(EventTime * 1000000)) AS M,"
        " count(*) AS PageViews FROM hits WHERE CounterID = 62"
        " AND EventDate >= DATE '2024-01-14' AND EventDate <= DATE '2024-01-15'"
        " AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY M ORDER BY M LIMIT 10 OFFSET 10"
    ),
    "ext_q0": (
        "SELECT count(DISTINCT SearchPhrase) AS n_SearchPhrase,"
        " count(DISTINCT MobilePhone) AS n_MobilePhone,"
        " count(DISTINCT MobilePhoneModel) AS n_MobilePhoneModel FROM hits"
    ),
    "ext_q1": (
        "SELECT count(DISTINCT HitColor) AS n_HitColor,"
        " count(DISTINCT BrowserCountry) AS n_BrowserCountry,"
        " count(DISTINCT BrowserLanguage) AS n_BrowserLanguage FROM hits"
    ),
    "ext_q2": (
        "SELECT BrowserCountry, count(DISTINCT SocialNetwork) AS n_SocialNetwork,"
        " count(DISTINCT HitColor) AS n_HitColor,"
        " count(DISTINCT BrowserLanguage) AS n_BrowserLanguage,"
        " count(DISTINCT SocialAction) AS n_SocialAction FROM hits GROUP BY BrowserCountry"
        " ORDER BY n_SocialNetwork DESC, BrowserCountry NULLS LAST LIMIT 10"
    ),
    "ext_q3": (
        "SELECT SocialSourceNetworkID, RegionID, count(*) AS c, round(avg(Age), 6) AS avg_age,"
        " round(avg(ParamPrice), 6) AS avg_price, round(stddev_samp(ParamPrice), 6) AS s,"
        " round(var_samp(ParamPrice), 6) AS v FROM hits GROUP BY SocialSourceNetworkID, RegionID"
        " HAVING stddev_samp(ParamPrice) IS NOT NULL"
        " ORDER BY stddev_samp(ParamPrice) DESC, SocialSourceNetworkID, RegionID LIMIT 10"
    ),
    "ext_q4": (
        "SELECT ClientIP, WatchID, count(*) AS c, min(ResponseStartTiming) AS tmin,"
        " round(median(ResponseStartTiming), 6) AS tmed, max(ResponseStartTiming) AS tmax"
        " FROM hits WHERE JavaEnable = 0 GROUP BY ClientIP, WatchID HAVING count(*) > 1"
        " ORDER BY median(ResponseStartTiming) DESC NULLS LAST, ClientIP, WatchID LIMIT 10"
    ),
    "ext_q5": (
        "SELECT ClientIP, WatchID, count(*) AS c, min(ResponseStartTiming) AS tmin,"
        " percentile_disc(0.95) WITHIN GROUP (ORDER BY ResponseStartTiming) AS tp95,"
        " max(ResponseStartTiming) AS tmax"
        " FROM hits WHERE JavaEnable = 0 GROUP BY ClientIP, WatchID HAVING count(*) > 1"
        " ORDER BY tp95 DESC NULLS LAST, ClientIP, WatchID LIMIT 10"
    ),
    "ext_q6": (
        "SELECT count(*) AS ShareCount FROM hits WHERE IsMobile = 1"
        " AND MobilePhoneModel LIKE 'iPhone%' AND SocialAction = 'share'"
        " AND SocialSourceNetworkID IN (5, 12) AND ClientTimeZone BETWEEN -5 AND 5"
        " AND regexp_matches(Referer, '/campaign/(spring|summer)_promo')"
        " AND CASE WHEN regexp_full_match(split_part(split_part(URL, 'resolution=', 2), '&', 1), '[0-9]+')"
        " THEN TRY_CAST(split_part(split_part(URL, 'resolution=', 2), '&', 1) AS INTEGER)"
        " ELSE 0 END > 1920"
        " AND levenshtein(UTMSource, UTMCampaign) < 3"
    ),
    "ext_q7": (
        "SELECT WatchID, min(ResolutionWidth) AS wmin, max(ResolutionWidth) AS wmax,"
        " CAST(sum(IsRefresh) AS BIGINT) AS srefresh FROM hits"
        " GROUP BY WatchID ORDER BY WatchID DESC LIMIT 10"
    ),
}

def _bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    module = web if name.startswith("cb_") else web_extended
    operator, parameters = getattr(module, name), PARAMETERS.get(name, {})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result(operator(hits(spark, sf_dir), **parameters))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(name) for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return {name: over_hits(sql) for name, sql in _SQL.items()}
