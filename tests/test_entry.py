"""The driver contract, and every registered query against its oracle on the smallest tables."""

import pytest
from naive_compare import oracle_rows, rows_of, views

import __spark_entry__ as entry
from vitalspan.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(DATA)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"guard_flags"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, con, name):
    assert rows_of(registry.QUERIES[name](spark, DATA)) == oracle_rows(con, registry.ORACLE_SQL[name])


def test_guard_flags(spark):
    assert registry.QUERIES["guard_flags"](spark, DATA).count() > 0
