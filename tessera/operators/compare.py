"""The surface of comparisons: scans, criteria, peers, matrices and their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .offers import beside_group, competitor_matrix
from .ordered import By, with_position

#: Ids that can be picked at once; they are broadcast.
MOST_PICKED = 10_000


def offers_of(df: DataFrame, order: str, **equals: str | None) -> DataFrame:
    """Rows whose columns equal the given values (None: any), by order."""
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy(order)


def ranked_by(df: DataFrame, criteria: dict[str, bool], criterion: str, ties: str, limit: int = 10) -> DataFrame:
    """The limit best by a criterion of a whitelist (column -> lower is better), nulls last both ways; an unknown one is an error."""
    if criterion not in criteria:
        raise ValueError(f"unknown criterion {criterion}: one of {', '.join(criteria)}")
    key = F.col(criterion).asc_nulls_last() if criteria[criterion] else F.col(criterion).desc_nulls_last()
    return df.orderBy(key, ties).limit(limit)


def criterion_sql(table: str, columns: list[str], criteria: dict[str, bool], criterion: str, ties: str) -> str:
    """The same as a statement with named parameters kind and n for spark.sql(..., args=...)."""
    if criterion not in criteria:
        raise ValueError(f"unknown criterion {criterion}: one of {', '.join(criteria)}")
    way = "ASC" if criteria[criterion] else "DESC"
    return f"SELECT {', '.join(columns)} FROM {table} WHERE kind = :kind ORDER BY {criterion} {way} NULLS LAST, {ties} LIMIT :n"


def in_given_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the given ids in their order, with position. At most MOST_PICKED may be given, and at least two must exist."""
    if len(ids) > MOST_PICKED:
        raise ValueError(f"more than {MOST_PICKED} ids")
    wanted = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(ids)], f"_id {df.schema[key].dataType.simpleString()}, position int")
    found = df.join(F.broadcast(wanted), F.col(key) == F.col("_id")).drop("_id")
    if found.select(key).distinct().limit(2).count() < 2:
        raise ValueError("at least two of the ids must exist")
    return found.orderBy("position")


def with_peers(df: DataFrame, key: str, kind: str, active: Column) -> DataFrame:
    """peers and me: of each row the active rows of its kind (null kind: none) counted, itself included even when not active."""
    facts = beside_group(df.withColumn("_active", F.coalesce(active, F.lit(False))), kind, _n=F.count_if("_active"))
    others = F.when(F.col(kind).isNull(), F.lit(0)).otherwise(F.col("_n") - F.col("_active").cast("int"))
    return facts.withColumn("peers", others + 1).drop("_active", "_n")


def axis_state(value: Column, n_known: Column, mixed_units: Column) -> Column:
    """Why an axis has no percentile: no value, mixed units or too few peers; null where it has one."""
    return F.when(value.isNull(), "deger_yok").when(mixed_units, "birim_karisik").when(n_known < 2, "yetersiz_eksen_kume")


def sorted_matrix(df: DataFrame, group: str, axes: dict[str, bool], names: list[str]) -> DataFrame:
    """The matrix with the most leads first, then by names."""
    return competitor_matrix(df, group, axes).orderBy(F.desc("n_leads"), *names)


def matrix_counts(df: DataFrame, group: str, who: str, axes: list[str]) -> DataFrame:
    """Per group: rows, distinct parties, and rows with a value on each axis."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(who).alias("n_who"), *[F.count(a).alias(f"n_{a}") for a in axes])


def explanation(winner: Column, n_missing: Column, axes: list[tuple[str, Column]]) -> Column:
    """One sentence: who leads, on what values, and how many values are missing."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("-"))) for name, value in axes]
    head = F.when(winner.isNull(), "no single leader").otherwise(F.concat(F.lit("leader "), winner.cast("string")))
    return F.concat_ws("; ", head, *lines, F.when(n_missing > 0, F.concat(n_missing.cast("string"), F.lit(" missing"))))


def summary(*parts: Column) -> Column:
    """The parts that aren't null, joined by commas; null with none."""
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def first_qualifying(df: DataFrame, group: str, key: str, needed: list[str]) -> DataFrame:
    """Of each group the row with the least key among those without nulls in needed; one aggregation."""
    sound = df.dropna(subset=needed)
    rest = [c for c in df.columns if c != group]
    return sound.groupBy(group).agg(F.min_by(F.struct(*rest), key).alias("_row")).select(group, "_row.*")


def coverage_time(df: DataFrame, key: list[str], day: str, today: Column) -> DataFrame:
    """One row: first and last day, mean versions of a key, keys with several, days since the last."""
    by_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("a"), F.max(day).alias("b"))
    return by_key.agg(
        F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.round(F.avg("n"), 2).alias("mean_versions"), F.count_if(F.col("n") > 1).alias("several"),
        F.greatest(F.lit(0), F.date_diff(today, F.max("b"))).alias("stale_days"),
    )


def contradictions(rate: Column, months: Column, unit: Column, reward: Column, start: Column, end: Column, url: Column) -> Column:
    """What doesn't fit together in a record, as an array of names."""
    return F.array_compact(F.array(
        F.when(rate.isNotNull() & months.isNull(), "rate_without_term"), F.when(rate > 20, "rate_above_20"), F.when(reward.isNotNull() & unit.isNull(), "reward_without_unit"),
        F.when(unit.isNotNull() & reward.isNull(), "unit_without_reward"), F.when(start > end, "start_after_end"), F.when(F.coalesce(url, F.lit("")) == "", "no_url"),
    ))


def history_list(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Per key its versions in order, numbered: one row a version with version and of."""
    return with_position(df.select(*key, *order, *fields), key, [By(c) for c in order], "version", "of")
