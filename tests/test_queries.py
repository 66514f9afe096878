"""Every core query against its SQL on the smallest tables, and every other one for a stable schema."""

import pytest
from oracle import both, connect

import __spark_entry__
from quirefold.plans.registry import core_queries, core_sql


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_query_equals_sql(spark, small, con, name):
    ours, theirs = both(spark, con, small, core_queries()[name], core_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(core_queries()) - set(core_sql())))
def test_other_query_runs(spark, small, name):
    df = core_queries()[name](spark, small)
    assert df.columns and df.count() >= 0


def test_sql_names_are_query_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["novel_id", "first_chapter", "repeated_chapter", "digest"]
