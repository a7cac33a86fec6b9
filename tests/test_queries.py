"""Every registered query with SQL gives the rows of its SQL on the smallest test data."""

import pytest

import __spark_entry__ as entry
from brindle import queries as core
from helpers import assert_same

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_rows_of_the_sql(spark, data, name):
    if name in SQL:
        assert_same(spark, data, core.queries()[name], SQL[name])
    else:
        core.queries()[name](spark, data).count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["o", "c", "name", "status"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
