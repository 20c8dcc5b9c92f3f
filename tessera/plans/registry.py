"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators import retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL of the same rows if there is any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def postings_sql(table: str, key: str, name: str) -> str:
    """Table expressions that end in name: key, term, tf."""
    return f"""{name}t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '{retrieval.TOKEN}')) AS term FROM {table}),
    {name}n AS (SELECT {key}, term, count(*) AS n FROM {name}t WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
    {name} AS (SELECT {key}, term, round(sum(n), 6) AS tf FROM (SELECT {key}, term, n::DOUBLE AS n FROM {name}n
      UNION ALL SELECT {key}, '~' || left(term, {T.STEM_LETTERS}), {T.STEM_WEIGHT}::DOUBLE * n FROM {name}n WHERE length(term) >= {T.STEM_FROM}) GROUP BY 1, 2)"""
