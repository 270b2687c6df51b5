"""Every registered query against its oracle SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from hitmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, sf_dir, name):
    assert oracle.spark_table(QUERIES[name](spark, sf_dir)) == oracle.duck_table(con, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["RegionID", "sum_adv", "c", "avg_width", "u"]
