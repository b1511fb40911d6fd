"""Guards: what a table must satisfy before an operator reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def filled(x: Column) -> Column:
    """A string with something other than blanks in it."""
    return x.isNotNull() & (F.length(F.trim(x)) > 0)


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, failing at the first row that breaks a rule; nothing is read twice.

    rules: message -> condition that must be true (null counts as broken).
    """
    verdict = F.lit(True)
    for message, rule in rules.items():
        verdict = F.when(F.coalesce(rule, F.lit(False)), verdict).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(verdict)


def empty_or_fail(offending: DataFrame, message: str) -> None:
    """Fail if there is any offending row; reads at most one."""
    if row := offending.head(1):
        raise ValueError(f"{message}: {row[0].asDict()}")
