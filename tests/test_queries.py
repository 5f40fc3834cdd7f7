"""Every query with SQL gives the SQL's rows; every other one runs and gives distinct, stable columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import compare

from corpusloom.plans import core_queries, core_sql


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_against_sql(spark, data, con, name):
    got, want = core_queries()[name](spark, data).toPandas(), con.execute(core_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)


@pytest.mark.parametrize("name", sorted(set(core_queries()) - set(core_sql()) - {"bpe_merges", "bpe_roundtrip", "pack_lanes", "pack_role_agnostic", "packing_quality"}))
def test_runs(spark, data, name):
    df = core_queries()[name](spark, data)
    assert df.columns and df.toPandas() is not None


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(core_queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["lane", "role", "docs", "bytes", "exact_dups"]
