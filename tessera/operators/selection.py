"""Choosing rows per group: quotas, splits, leading groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, group: str, key: str, quota: int, target: int) -> DataFrame:
    """Rounds over the groups, each giving its next row by key, up to quota per group and target in all."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return df.withColumn("turn", turn).where(F.col("turn") <= quota).orderBy("turn", F.col(group).asc_nulls_last(), key).limit(target)


def stratified_split(df: DataFrame, group: str, key: str, share: float = 0.2, least: int = 3) -> DataFrame:
    """group, key, part: per group max(1, round(share * n)) keys, the first by md5, are test if n >= least; the rest is train.

    A key is ranked inside its bin of md5 prefixes after the counts of earlier bins, so that a hot group is sorted by many tasks.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.select(group, key).distinct().withColumn("_digest", digest).withColumn("_bin", F.substring("_digest", 1, 3))
    bins = rows.groupBy(F.col(group).alias("_group"), F.col("_bin").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_group")
    upto = F.sum("_n").over(inside.orderBy("_of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    bins = bins.select("_group", "_of", upto.alias("_before"), F.sum("_n").over(inside).alias("_all"))
    place = F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_digest", key)) + F.col("_before")
    ranked = rows.join(bins, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bin") == F.col("_of"))).withColumn("_place", place)
    taken = F.when(F.col("_all") >= least, F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("_all"), 0).cast("long"))).otherwise(0)
    return ranked.select(group, key, F.when(F.col("_place") <= taken, "test").otherwise("train").alias("part"))


def leading_groups(df: DataFrame, group: str, k: int, rest: str) -> DataFrame:
    """group, n: the k largest groups, and all others together under the name of the rest."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    lead = sizes.orderBy(F.desc("n"), group).limit(k).select(F.col(group).alias("_lead"))
    named = sizes.join(F.broadcast(lead), F.col(group).eqNullSafe(F.col("_lead")), "left")  # k rows
    return named.groupBy(F.coalesce("_lead", F.lit(rest)).alias(group)).agg(F.sum("n").alias("n"))


def keyword_class(text: Column, classes: dict[str, list[str]]) -> Column:
    """struct(class, hits): the class with most contained keywords, the first of equals; null without a hit."""
    tally = [
        F.struct(sum((text.contains(w).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
        for i, (name, words) in enumerate(classes.items())
    ]
    best = F.array_max(F.array(*tally))
    return F.when(best["hits"] > 0, F.struct(best["name"].alias("name"), best["hits"].alias("hits")))
