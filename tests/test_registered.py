"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import TESTDATA, compare, connect

SF = f"{TESTDATA}/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"case_id", "entries", "valid_prefix", "chain_ok", "first_bad_position", "head"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, detail, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, detail
