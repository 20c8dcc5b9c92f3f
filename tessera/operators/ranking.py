"""Ranking with the rule that a missing value is never zero and never wins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import By, with_position


def rank_nulls_last(df: DataFrame, value: str, ties: list[str], descending: bool = False, within: list[str] | None = None) -> DataFrame:
    """Add position: 1..n by value, nulls last in either direction, ties by the given columns."""
    return with_position(df, within or [], [By(value, descending, nulls_last=True), *[By(c) for c in ties]])
