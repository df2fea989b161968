"""Every registered query against its DuckDB SQL, on the sf0.001 tables."""

import os

import pytest

import __spark_entry__ as E
from streamwatch.plans.jobs import JOBS
from oracle_check import compare, duck

SF = os.environ.get("SW_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query_matches_oracle(spark, con, name):
    assert name in SQL, f"{name} has no oracle SQL"
    r = compare(spark, name, E.queries()[name], SQL[name], SF, con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"window_start", "window_end", "province", "n"}
    assert df.limit(5).count() > 0
