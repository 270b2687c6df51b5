"""All registered queries in one place."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hitmill.plans import ingest, regress, suite, triage, web
from hitmill.session import prepare

MODULES = (web, regress, ingest, triage, suite)

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(q) for module in MODULES for name, q in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
