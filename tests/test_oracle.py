"""Every registered query against its DuckDB twin (the driver's gate)."""

import pytest

import __spark_entry__ as ent
from conftest import SF_SMALL
from oracle import compare, duck
from parlance.plans import registry
from parlance.plans.registry import load_all

load_all()
QUERIES, SQL = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql_or_is_listed():
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only <= {"classify_ml", "rank_candidates"}, rows_only


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert r["status"] == "exact", r


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.columns == ["label", "country", "rank", "word", "c_gw", "pmi"]
    assert df.count() > 0
