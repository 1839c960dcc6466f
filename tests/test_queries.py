"""Every registered query of the core runs at the smallest scale, and agrees with its SQL."""

import pytest
from compare import check

import __spark_entry__ as entry
from paperloom.plans import registry


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(registry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql().get(name))
