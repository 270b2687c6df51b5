"""Statements of another dialect against the operators."""

import pytest

from hitmill.operators import web, web_extended
from hitmill.plans.tables import hits
from hitmill.sql_text import SqlText, spark_text

CASES = [
    ("x ~ '^\\d+$'", "x RLIKE '^\\d+$'"),
    ("NOT x !~ 'a~b'", "NOT x NOT RLIKE 'a~b'"),
    ("~ 5", "~ 5"),
    ("SELECT f(a, 'b')::INT, \"c d\"::BIGINT, 5 :: DOUBLE", "SELECT TRY_CAST(f(a, 'b') AS INT), TRY_CAST(\"c d\" AS BIGINT), TRY_CAST(5 AS DOUBLE)"),
    ("SELECT (a + 1)::INT", "SELECT TRY_CAST((a + 1) AS INT)"),
    ("FROM 'a b' JOIN 'c'", "FROM `a b` JOIN `c`"),
    ("SELECT 'from' FROM hits", "SELECT 'from' FROM hits"),
    ("regexp_replace(x, '(a)\\1', 'to_timestamp_seconds(\\1) $ \\2')", "regexp_replace(x, '(a)\\1', 'to_timestamp_seconds($1) \\$ $2')"),
    ("regexp_replace(upper(concat(a, '\\1')), f(b, '\\2'), '\\0')", "regexp_replace(upper(concat(a, '\\1')), f(b, '\\2'), '$0')"),
    ("VAR(x) + var -- VAR(x)\n, /* VAR( */ \"VAR\"", "var_samp(x) + var , \"VAR\""),
    ("approx_percentile_cont(0.95) WITHIN GROUP (ORDER BY f(\"x\") ASC) p", "approx_percentile(f(\"x\"), 0.95) p"),
    ("approx_percentile_cont(x, 0.5)", "approx_percentile_cont(x, 0.5)"),
    ("SELECT 'it''s';", "SELECT 'it''s'"),
]


@pytest.mark.parametrize("text, want", CASES)
def test_tokens(text, want):
    assert " ".join(spark_text(text).split()) == want


@pytest.fixture(scope="module")
def sql(spark, sf_dir):
    return SqlText(spark, hits=hits(spark, sf_dir))


def same(got, want):
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_settings_are_put_back(spark, sql):
    sql.run("SELECT 1")
    assert spark.sql('SELECT "URL" AS x').first().x == "URL"
    with pytest.raises(Exception):
        sql.run("SELECT nothing FROM nowhere")
    assert spark.sql(r"SELECT 'a\\b' AS x").first().x == "a\\b"


def test_match_gives_the_first_match_or_null(sql):
    row = sql.run("SELECT regexp_match('a12b3', '\\d+') AS one, regexp_match('ab', '\\d') AS none").first()
    assert row.one == ["12"] and row.none is None


def test_statements_equal_the_operators(spark, sf_dir, sql, tmp_path):
    table = hits(spark, sf_dir)
    same(sql.run('SELECT COUNT(DISTINCT "UserID") FROM hits'), web.cb_q4(table))
    same(sql.run('SELECT "UserID" FROM hits WHERE "UserID" = :user', user=41), web.cb_q19(table, user_id=41))
    minutes = """SELECT "UserID", extract(minute FROM to_timestamp_seconds("EventTime")) AS m, "SearchPhrase", COUNT(*)
        FROM 'hits' GROUP BY "UserID", m, "SearchPhrase" ORDER BY COUNT(*) DESC, 1, 2, 3 LIMIT 10;"""
    same(sql.run(minutes), web.cb_q18(table))
    (tmp_path / "minutes.sql").write_text(minutes)
    same(sql.run_file(str(tmp_path / "minutes.sql")), web.cb_q18(table))
    same(
        sql.run('SELECT 1, "URL", COUNT(*) AS c FROM hits GROUP BY 1, "URL" ORDER BY c DESC, 2 LIMIT 10'),
        web.cb_q34(table),
    )
    same(
        sql.run("""SELECT "ClientIP", "WatchID", COUNT(*) c, MIN("ResponseStartTiming"),
            MAX("ResponseStartTiming"), APPROX_PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY "ResponseStartTiming") tail
            FROM 'hits' WHERE "JavaEnable" = 0 GROUP BY "ClientIP", "WatchID" HAVING c > 1
            ORDER BY tail DESC, 1, 2 LIMIT 10"""),
        web_extended.ext_q5(table).select("ClientIP", "WatchID", "c", "tmin", "tmax", "tp95"),
    )
