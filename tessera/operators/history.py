"""Versions of a key over time: latest, first against last, changes, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import By, with_previous


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order; one aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_and_last(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Per key the number of versions and, of each field, first and last value and whether they differ."""
    at = F.struct(*order)
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("versions"),
        *[F.min_by(c, at).alias(f"first_{c}") for c in fields], *[F.max_by(c, at).alias(f"last_{c}") for c in fields],
    )
    return out.select("*", *[(~F.col(f"first_{c}").eqNullSafe(F.col(f"last_{c}"))).alias(f"changed_{c}") for c in fields])


def keep_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows with one content (white space collapsed, lower case) the first: content_hash and that row's order value."""
    flat = F.trim(F.regexp_replace(F.lower(F.replace(F.col(text), F.lit("İ"), F.lit("i"))), "(?U)\\s+", " "))
    return df.groupBy(F.sha2(flat, 256).alias("content_hash")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def changed(new: DataFrame, old: DataFrame, key: str, content_hash: str) -> DataFrame:
    """Rows of new whose key is unknown in old or has another hash there (old: one row per key)."""
    known = old.select(F.col(key).alias("_key"), F.col(content_hash).alias("_hash"))
    return new.join(known, (F.col(key) == F.col("_key")) & F.col(content_hash).eqNullSafe(F.col("_hash")), "left_anti")


def fill_rates(df: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Per group and field: filled, total and percent with one digit."""
    ids = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in fields])
    return ids.unpivot([*group, "total"], fields, "field", "filled").withColumn("percent", F.round(F.col("filled") * F.lit(100.0) / F.col("total"), 1))


def changes(df: DataFrame, key: list[str], order: list[str], content: str) -> DataFrame:
    """The versions whose content differs from that of the version before; a key's first version is one."""
    marked = with_previous(df, key, [By(c) for c in order], content, "_before")
    return marked.where(F.col("_before").isNull() | ~F.col(content).eqNullSafe(F.col("_before.content"))).drop("_before")


def version_stats(df: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Per group: snapshots, distinct keys, mean versions of a key, keys with several versions."""
    by_key = df.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy(*group).agg(
        F.sum("n").alias("snapshots"), F.count(F.lit(1)).alias("n_keys"), F.round(F.avg("n"), 4).alias("mean_versions"), F.count_if(F.col("n") > 1).alias("several"),
    )


def duplicates(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, first: rows whose text an earlier key has too; null texts are no duplicates. Hashes travel, texts don't."""
    hashed = df.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("_hash"))
    first = hashed.groupBy("_hash").agg(F.min(key).alias("first"))
    return hashed.join(first, "_hash").where(F.col(key) != F.col("first")).select(key, "first")


def both_axes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two tables counted per key, 0 where one side lacks it: key, n_left, n_right."""
    a, b = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left")), right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    return a.join(b, key, "full_outer").na.fill(0, ["n_left", "n_right"])
