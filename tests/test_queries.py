"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, text, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
