"""Every query that SQL can express gives what DuckDB gives."""

from __future__ import annotations

import pytest

from sparkwake import registry

from .oracle import SF, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
