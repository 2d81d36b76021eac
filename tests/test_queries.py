"""Every query with SQL gives the SQL's rows; every other runs and keeps its schema."""

from __future__ import annotations

import pytest

from sparkloom.plans.catalogue import ORACLES, QUERIES
from tests.compare import connection, same


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


#: Queries that rank or list rows, on a table where rows tie.
TIES = "commits_by_date files_by_class reviews_by_time pull_requests_nested reviewers_distinct commit_phase size_truncate context_pack index_upsert_last_wins".split()


@pytest.mark.parametrize("name", TIES)
def test_ties_as_sql(spark, name):
    larger = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, larger), connection(larger), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).select("asked").distinct().count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
