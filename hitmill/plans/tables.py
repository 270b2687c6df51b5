"""The library's input tables, derived from the star-schema test tables.

Each table has a Spark form and a DuckDB common table expression with the same
rows. Column expressions are plain SQL that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitmill.sources.hits import load_hits, write_hits
from hitmill.staging import new_path

# ``e`` is the event, ``p`` its page, ``r`` the referring page, ``d`` a document.
# {pages} is the number of pages.
HITS_COLUMNS = {
    "WatchID": "CAST(e.event_id % 607 AS BIGINT)",
    "CounterID": "CAST(CASE WHEN e.event_id % 4 = 0 THEN 62 ELSE e.user_id % 90 END AS INT)",
    "EventDate": "CAST(e.ts AS DATE)",
    "EventTime": "{seconds}",
    "UserID": "e.user_id",
    "ClientIP": "CAST(e.event_id % 607 % 251 - 2147483648 AS INT)",
    "ClientTimeZone": "CAST(e.user_id % 13 - 6 AS SMALLINT)",
    "RegionID": "CAST(e.user_id % 25 AS INT)",
    "AdvEngineID": "CAST(CASE WHEN e.event_id % 10 < 7 THEN 0 ELSE e.event_id % 10 END AS SMALLINT)",
    "SearchEngineID": "CAST(CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.event_id % 5 END AS SMALLINT)",
    "TraficSourceID": "CAST(e.event_id % 9 - 1 AS SMALLINT)",
    "SearchPhrase": "CASE WHEN e.event_id % 5 < 2 THEN '' ELSE d.lang || ' ' || d.source END",
    "URL": (
        "CASE WHEN e.event_id % 50 = 49 THEN ''"
        " WHEN e.event_id % 100 = 23 THEN p.url || '?resolution=99999999999'"
        " WHEN e.event_id % 20 = 3"
        " THEN p.url || '?resolution=' || CAST(1000 + e.event_id % 2003 AS STRING) || '&z=1'"
        " ELSE p.url END"
    ),
    "URLHash": "CAST(e.event_id % {pages} AS BIGINT)",
    "Referer": (
        "CASE WHEN e.event_id % 7 = 0 THEN ''"
        " WHEN e.event_id % 20 IN (3, 4) THEN r.url || '/campaign/spring_promo'"
        " ELSE r.url END"
    ),
    "RefererHash": "CAST((e.event_id * 31) % 8 AS BIGINT)",
    "Title": "p.title",
    "ResolutionWidth": "CAST(320 + e.event_id * 7 % 1700 AS SMALLINT)",
    "WindowClientWidth": "CAST(e.event_id % 17 * 80 AS SMALLINT)",
    "WindowClientHeight": "CAST(e.event_id % 11 * 60 AS SMALLINT)",
    "JavaEnable": "CAST(e.event_id % 607 % 2 AS SMALLINT)",
    "ResponseStartTiming": (
        "CASE WHEN e.event_id % 12 = 5 THEN NULL ELSE CAST(floor(e.value * 100) AS INT) END"
    ),
    "IsRefresh": "CAST(CASE WHEN e.event_id % 11 = 1 THEN 1 ELSE 0 END AS SMALLINT)",
    "IsLink": "CAST(e.event_id % 3 AS SMALLINT)",
    "IsDownload": "CAST(CASE WHEN e.event_id % 13 = 1 THEN 1 ELSE 0 END AS SMALLINT)",
    "DontCountHits": "CAST(CASE WHEN e.event_id % 19 = 1 THEN 1 ELSE 0 END AS SMALLINT)",
    "IsMobile": "CAST(e.event_id % 2 AS SMALLINT)",
    "MobilePhone": "CAST(e.event_id % 6 AS SMALLINT)",
    "MobilePhoneModel": (
        "CASE WHEN e.event_id % 20 = 3 THEN 'iPhone 6' WHEN e.event_id % 6 = 0 THEN ''"
        " ELSE 'model ' || CAST(e.user_id % 12 AS STRING) END"
    ),
    "HitColor": "CASE WHEN e.event_id % 29 = 0 THEN NULL ELSE d.lang END",
    "BrowserCountry": (
        "CASE WHEN e.user_id % 7 = 0 THEN NULL ELSE 'c' || CAST(e.user_id % 14 AS STRING) END"
    ),
    "BrowserLanguage": "d.lang",
    "SocialNetwork": (
        "CASE WHEN e.event_id % 8 = 0 THEN '' ELSE 'n' || CAST(e.event_id % 8 AS STRING) END"
    ),
    "SocialAction": "CASE WHEN e.event_id % 20 = 3 THEN 'share' ELSE e.event_type END",
    "SocialSourceNetworkID": (
        "CAST(CASE WHEN e.event_id % 20 = 3 THEN 5 ELSE e.event_id % 14 END AS SMALLINT)"
    ),
    "Age": "CAST(e.user_id % 70 AS SMALLINT)",
    "ParamPrice": (
        "CAST(CASE WHEN e.event_id % 30 = 0 THEN NULL ELSE floor(e.value * 100) END AS BIGINT)"
    ),
    "UTMSource": "'src' || CAST(e.event_id % 9 AS STRING)",
    "UTMCampaign": "'src' || CAST(e.event_id % 1000 AS STRING)",
}

RESULTS_COLUMNS = {
    "benchmark_name": "'clickbench_partitioned'",
    "query_name": "'q' || CAST(l_linenumber AS STRING)",
    "query_type": "CASE WHEN l_quantity < 5 THEN 'table_creation' ELSE 'query' END",
    "execution_time": "l_extendedprice / 100000",
    "run_timestamp": "'2025-06-01 00:00:00'",
    "git_revision": "'r' || CAST(l_suppkey % 20 AS STRING)",
    "git_revision_timestamp": (
        "'2025-03-' || lpad(CAST(l_suppkey % 20 + 2 AS STRING), 2, '0')"
        " || CASE WHEN l_suppkey % 2 = 0 THEN 'T02:00:00+08:00' ELSE 'T22:00:00+00:00' END"
    ),
    "num_cores": "CAST(16 AS BIGINT)",
}

COMMITS_COLUMNS = {
    "revision": "'c' || CAST(o_orderkey AS STRING)",
    "time": "{minutes}",
    "url": "'https://example.org/commit/' || CAST(o_orderkey AS STRING)",
}

# {lf} and {cr} are the line separators, spelled by each engine.
COMMENTS_COLUMNS = {
    "id": "event_id",
    "repo": "CASE WHEN event_id % 3 = 0 THEN 'org/b' ELSE 'org/a' END",
    "login": "'u' || CAST(user_id % 20 AS STRING)",
    "body": (
        "CASE event_id % 12"
        " WHEN 0 THEN 'run benchmarks'"
        " WHEN 1 THEN ' Run Benchmarks '"
        " WHEN 2 THEN 'run benchmark tpch'"
        " WHEN 3 THEN 'run benchmark tpch sql_planner'"
        " WHEN 4 THEN 'run benchmark tpch nosuch'"
        " WHEN 5 THEN 'run benchmark tpch_mem' || {lf} || 'MEM_LIMIT=1G' || {lf} || 'bad=x' || {lf} || 'A=b;c'"
        " WHEN 6 THEN 'run benchmark tpch' || {cr} || {lf} || 'X_1=2'"
        " WHEN 7 THEN 'SHOW benchmark queue'"
        " WHEN 8 THEN ''"
        " WHEN 9 THEN 'looks good'"
        " WHEN 10 THEN 'run benchmark  tpch   tpch_mem  '"
        " ELSE 'hello' || {lf} || 'run benchmarks' END"
    ),
    "html_url": "'https://x.example/c/' || CAST(event_id % 9000 AS STRING)",
    "issue_url": (
        "'https://api.x.example/issues/' || CAST(event_id % 400 AS STRING)"
        " || CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END"
    ),
    "created_at": "CAST(ts AS TIMESTAMP)",
    "updated_at": "CAST(ts AS TIMESTAMP)",
}


def _select(columns: dict[str, str], **words: object) -> list[str]:
    out = []
    for name, text in columns.items():
        for word, value in words.items():
            text = text.replace("{" + word + "}", str(value))
        out.append(f"{text} AS {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(
    spark: SparkSession, sf_dir: str, name: str, sql: str, source: str, **words: str
) -> DataFrame:
    """A stored table from SQL over one test table, written ``{source}`` in the text."""

    def build() -> DataFrame:
        text = sql
        for word, value in words.items():
            text = text.replace("{" + word + "}", value)
        return spark.sql(text, **{source: table(spark, sf_dir, source)})

    return stored(spark, sf_dir, name, build)


def derived_cte(name: str, sql: str, source: str, **words: str) -> str:
    """The same table for DuckDB."""
    for word, value in {**words, source: source}.items():
        sql = sql.replace("{" + word + "}", value)
    return f"{name} AS ({sql})"


# --- Spark ------------------------------------------------------------------


def hits_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits rows, derived lazily.

    Only the needed columns of the page and document tables enter the joins; the
    title is cut out of the page text before the shuffle.
    """
    pages = table(spark, sf_dir, "pages")
    documents = table(spark, sf_dir, "documents")
    n_pages, n_documents = pages.count(), documents.count()
    e = table(spark, sf_dir, "events").alias("e")
    p = pages.select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    ).alias("p")
    r = pages.select("page_id", "url").alias("r")
    d = documents.select("doc_id", "lang", "source").alias("d")
    joined = (
        e.join(p, F.col("p.page_id") == F.col("e.event_id") % n_pages)
        .join(r, F.col("r.page_id") == (F.col("e.event_id") * 31) % n_pages)
        .join(d, F.col("d.doc_id") == (F.col("e.event_id") * 17) % n_documents)
    )
    seconds = "unix_seconds(CAST(e.ts AS TIMESTAMP))"
    return joined.selectExpr(*_select(HITS_COLUMNS, pages=n_pages, seconds=seconds))


# Tables written by this process: (application, folder, name) -> table.
_written: dict[tuple[str, str, str], DataFrame] = {}


def _once(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None],
    load: Callable[[str, T.StructType], DataFrame],
) -> DataFrame:
    """The library's inputs are stored tables; each is written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written or _written[key].sparkSession is not spark:
        view, path = build(), new_path(spark, name)
        write(view, path)
        _written[key] = load(path, view.schema)
    return _written[key]


def _write_rows(df: DataFrame, path: str) -> None:
    """Write a table without moving rows, unless the input is too small to split."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots)
    df.write.parquet(path)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits table as a Parquet directory with one folder per day."""
    return _once(
        spark,
        sf_dir,
        "hits",
        lambda: hits_view(spark, sf_dir),
        write_hits,
        lambda path, schema: load_hits(spark, path, schema),
    )


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived input table as Parquet files."""
    return _once(
        spark,
        sf_dir,
        name,
        build,
        _write_rows,
        lambda path, schema: spark.read.schema(schema).parquet(path),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return table(spark, sf_dir, "lineitem").selectExpr(*_select(RESULTS_COLUMNS))

    return stored(spark, sf_dir, "results", build)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = (
        "CAST(o_orderdate AS TIMESTAMP)"
        " + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0)"
    )

    def build() -> DataFrame:
        return table(spark, sf_dir, "orders").selectExpr(*_select(COMMITS_COLUMNS, minutes=minutes))

    return stored(spark, sf_dir, "commits", build)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return table(spark, sf_dir, "events").selectExpr(
            *_select(COMMENTS_COLUMNS, lf="char(10)", cr="char(13)")
        )

    return stored(spark, sf_dir, "comments", build)


# --- DuckDB -----------------------------------------------------------------


def _cte(name: str, columns: list[str], source: str) -> str:
    listed = ",\n    ".join(columns)
    return f"{name} AS (\n  SELECT {listed}\n  FROM {source})"


HITS_CTE = _cte(
    "hits",
    _select(
        {**HITS_COLUMNS, "Title": "regexp_extract(p.html, '<title>([^<]*)</title>', 1)"},
        pages="cp.np",
        seconds="CAST(epoch(date_trunc('second', e.ts)) AS BIGINT)",
    ),
    "events e CROSS JOIN (SELECT count(*) AS np FROM pages) cp"
    " CROSS JOIN (SELECT count(*) AS nd FROM documents) cd"
    " JOIN pages p ON p.page_id = e.event_id % cp.np"
    " JOIN pages r ON r.page_id = (e.event_id * 31) % cp.np"
    " JOIN documents d ON d.doc_id = (e.event_id * 17) % cd.nd",
)
RESULTS_CTE = _cte("benchmark_results", _select(RESULTS_COLUMNS), "lineitem")
COMMITS_CTE = _cte(
    "commits",
    _select(COMMITS_COLUMNS, minutes="o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER))"),
    "orders",
)
COMMENTS_CTE = _cte("comments", _select(COMMENTS_COLUMNS, lf="chr(10)", cr="chr(13)"), "events")


def over_hits(sql: str) -> str:
    return f"WITH {HITS_CTE}\n{sql}"


def over_results(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([RESULTS_CTE, *more]) + f"\n{sql}"


def over_commits(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([COMMITS_CTE, *more]) + f"\n{sql}"


def over_comments(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([COMMENTS_CTE, *more]) + f"\n{sql}"
