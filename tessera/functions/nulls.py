"""Columns that keep "not stated" apart from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_fields(columns: list[str]) -> Column:
    """Names of the null columns in the given order, joined by commas."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
