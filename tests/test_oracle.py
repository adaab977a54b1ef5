"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as entry
from revlens.plans.queries import QUERIES as OWN
from tests.oracle_harness import compare, duck

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_oracle_or_is_listed():
    without = sorted(set(OWN) - set(SQL))
    assert not without, without
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, sf, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], sf)
    assert r["values_ok"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "overall_status" in df.columns
