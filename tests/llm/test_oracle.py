"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from sparkwake.llm import queries, sql

from ..oracle import SF, connection, same


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), sql.oracle_sql()[name], connection())
