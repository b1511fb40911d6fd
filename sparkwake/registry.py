"""All registered queries of the time-series operators, with their SQL."""

from __future__ import annotations

from .plans import queries_asof, queries_folds, queries_gates, queries_learning, queries_panels, queries_path

_ALL = queries_asof.Q | queries_path.Q | queries_learning.Q | queries_folds.Q | queries_gates.Q | queries_panels.Q


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
