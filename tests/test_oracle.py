"""Every registered query against its DuckDB twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest, duck  # noqa: E402
from tidings.catalog import NO_ORACLE, ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle_or_a_reason():
    assert set(ORACLE_SQL) | set(NO_ORACLE) == set(QUERIES) <= set(E.queries())
    assert not set(ORACLE_SQL) & set(NO_ORACLE)


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLE_SQL])
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(E.oracle_sql()[name])
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(s_rows) == len(d_rows)
    assert digest(sdf.columns, s_rows)[0] == digest(rel.columns, d_rows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["company", "Negative", "Neutral", "Positive", "Total"]
    assert len(rows) == 6
