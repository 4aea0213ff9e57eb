"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import differences, oracle_connection

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    query = entry.queries()[name]
    if name in SQL:
        assert differences(spark, oracle, query, SQL[name], SF) is None
    else:
        assert query(spark, SF).count() > 0


def test_entry_returns_the_flagship(spark):
    assert {"tool", "total_tokens", "call_count", "active_seconds"} <= set(
        entry.entry(spark).columns
    )
