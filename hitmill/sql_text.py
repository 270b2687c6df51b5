"""SQL text of other engines' web-analytics suites, run as it is.

Spark reads most of it with two settings: double quotes around names, and literals in which a
backslash is a backslash. What Spark spells differently is mapped token by token, outside
of literals and comments; names that Spark lacks and that are plain expressions are functions
of the session, defined in SQL. Values come in as parameter markers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# How the text is read.
READING = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.parser.escapedStringLiterals": "true",
}

# Functions and aggregates under another name, with the same arguments.
NAMES = {
    "to_timestamp_seconds": "timestamp_seconds",
    "var": "var_samp",
    "stddev": "stddev_samp",
    "median": "median",
    "strpos": "instr",
    "approx_distinct": "approx_count_distinct",
    "array_agg": "collect_list",
    "bool_and": "every",
    "bool_or": "some",
}

# Names that Spark lacks.
FUNCTIONS = (
    "regexp_match(s STRING, p STRING) RETURNS ARRAY<STRING>"
    " RETURN CASE WHEN rlike(s, p) THEN array(regexp_substr(s, p)) END",
)

_TOKENS = re.compile(
    r"""(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<literal>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`)"""
    r"""|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<number>\d+(?:\.\d+)?)|(?P<space>\s+)|(?P<sign>::|!~|<=|>=|<>|!=|.)""",
    re.DOTALL,
)


def spark_text(text: str) -> str:
    """The text with what Spark spells differently mapped.

    ``FROM 'name'`` names a table; ``x ~ p`` is RLIKE; ``x::type`` is a cast that gives NULL
    instead of an error; ``\\1`` in a replacement is ``$1``; an approximate
    percentile WITHIN GROUP takes its column as an argument; functions are renamed by NAMES.
    """
    out: list[str] = []
    # Open calls: where they begin in ``out``, their function, and the commas so far.
    calls: list[list[Any]] = []
    operand = 0
    tokens = [(m.lastgroup, m.group()) for m in _TOKENS.finditer(text.strip().rstrip(";"))]
    i = 0
    while i < len(tokens):
        kind, token = tokens[i]
        i += 1
        if kind in ("space", "comment"):
            out.append(" ")
            continue
        words = [t for t in out if not t.isspace()]
        last = words[-1].lower() if words else ""
        if kind == "literal" and last in ("from", "join"):
            operand = len(out)
            out.append("`" + token[1:-1].replace("''", "'") + "`")
        elif kind == "literal":
            if calls and calls[-1][1] == "regexp_replace" and calls[-1][2] == 2:
                token = re.sub(r"\\(\d)", r"$\1", token.replace("$", r"\$"))
            operand = len(out)
            out.append(token)
        elif kind == "word" and _opens(tokens, i) and token.lower() in NAMES:
            operand = len(out)
            out.append(NAMES[token.lower()])
        elif token == "(":
            begin = operand if out and words and re.fullmatch(r"[A-Za-z_0-9]+", words[-1]) and not out[-1].isspace() else len(out)
            calls.append([begin, last, 0])
            out.append(token)
        elif token == ")":
            begin, name, _ = calls.pop() if calls else (len(out), "", 0)
            out.append(token)
            operand = begin
            if name == "approx_percentile_cont":
                i = _within_group(tokens, i, out, begin)
        elif token == "," and calls:
            calls[-1][2] += 1
            out.append(token)
        elif token in ("~", "!~") and last not in ("", "(", ",", "=", "and", "or", "not", "where", "when", "select"):
            out.append(" RLIKE " if token == "~" else " NOT RLIKE ")
        elif token == "::":
            while tokens[i][0] == "space":
                i += 1
            out[operand:] = ["TRY_CAST(", *out[operand:], f" AS {tokens[i][1]})"]
            i += 1
        else:
            if kind in ("word", "name", "number"):
                operand = len(out)
            out.append(token)
    return "".join(out)


def _opens(tokens: list[tuple[str | None, str]], i: int) -> bool:
    return i < len(tokens) and tokens[i][1] == "("


def _within_group(tokens: list[tuple[str | None, str]], i: int, out: list[str], begin: int) -> int:
    """Turn ``f(share) WITHIN GROUP (ORDER BY x)`` into ``approx_percentile(x, share)``."""
    rest = [j for j in range(i, len(tokens)) if tokens[j][0] not in ("space", "comment")]
    if [tokens[j][1].lower() for j in rest[:5]] != ["within", "group", "(", "order", "by"]:
        return i
    depth, j = 1, rest[4] + 1
    column = []
    while depth:
        depth += {"(": 1, ")": -1}.get(tokens[j][1], 0)
        column.append(tokens[j][1])
        j += 1
    share = "".join(out[begin:]).split("(", 1)[1][:-1]
    ordered = re.sub(r"\s+asc\s*$", "", "".join(column[:-1]).strip(), flags=re.IGNORECASE)
    out[begin:] = [f"approx_percentile({spark_text(ordered)}, {share})"]
    return j


@contextmanager
def _reading(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in READING}
    for key, value in READING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class SqlText:
    """Runs statements over tables; ``SqlText(spark, hits=df).run(text, counter=62)``."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark = spark
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
        with _reading(spark):
            for function in FUNCTIONS:
                spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")

    def run(self, text: str, **parameters: Any) -> DataFrame:
        """The result of one statement, with ``:name`` markers bound to the parameters."""
        with _reading(self.spark):
            return self.spark.sql(spark_text(text), args=parameters or None)

    def run_file(self, path: str, **parameters: Any) -> DataFrame:
        """The result of a file that holds one statement, on any store Spark reads."""
        lines = self.spark.read.text(path, wholetext=True).first()
        return self.run(lines.value, **parameters)
