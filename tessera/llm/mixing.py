"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source with target weight w (of all weights) and n of N rows gets the mean repetition rate
epochs * N * w / n. Each document's number of copies is the inverse of the Poisson distribution with
that mean at a uniform number hashed from the document's id and a seed, so that a rerun or a lost
executor gives the same copies. Copies are dealt to partitions and sorted there by a second hash, which
shuffles them over the whole result.

The distribution functions are tabulated once per source, as a sum of log-terms that doesn't underflow, for rates up to ``WIDE``. Beyond, the
inverse is found for each document by one walk over the numbers within 10 standard deviations of the mean, as many as 20 square roots of the
rate, and nothing is kept. Documents of very many copies are exploded in pieces by many tasks. The table of sources is broadcast only if it has at most ``BROADCAST_SOURCES`` rows; otherwise documents
join it by source and one of ``SALTS`` salts, so that a hot source is read by many tasks.

Defined results: a null source is a source of its own; sources without a target weight share
``rest_weight`` each; weight 0 leaves a source out; null ids hash as empty text; rows with equal ids get
the same number of copies each; null and empty texts are mixed like others; an empty table gives no
rows; extra columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BROADCAST_SOURCES = 10_000
#: The rate from which the walk starts above 0; copies of a document that one task makes.
WIDE, PIECE = 400.0, 10_000
_FACTS = ("rate", "cdf")
SALTS = 32
SEED = 7


def hashed_unit(key: Column, purpose: str, seed: int) -> Column:
    """A uniform number in [0, 1) from the first 13 hexadecimal digits of an MD5."""
    text = F.concat(F.lit(f"{purpose}:{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def _distribution(rate: Column) -> Column:
    """P(copies <= k) for k from 0 to 10 standard deviations above the mean; null for rates over WIDE."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 10).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["log"] + F.log(rate) - F.log(k.cast("double"))).alias("log"),
            F.concat(
                acc["cdf"],
                F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["log"] + F.log(rate) - F.log(k.cast("double")))),
            ).alias("cdf"),
        ),
    )
    return F.when(rate > WIDE, F.lit(None)).when(rate > 0, step["cdf"]).otherwise(F.array(F.lit(1.0)))


def _walked(unit: Column, rate: Column) -> Column:
    """How many k have P(copies <= k) <= unit for rates over WIDE: one walk over the k within 10 standard deviations of the mean, without keeping them."""
    low = F.floor(rate - 10 * F.sqrt(rate)).cast("long")
    # the first probability by its distance from the mean: no large terms cancel out
    d = low / rate - 1
    stirling = 1 / (12 * low) - 1 / (360 * low.cast("double") * low * low)
    first = F.exp(-rate * ((1 + d) * F.log1p(d) - d) - stirling - 0.5 * F.log(2 * math.pi * low))
    start = F.struct(first.alias("p"), F.lit(0.0).alias("total"), low.alias("below"))

    def step(acc: Column, k: Column) -> Column:
        total = acc["total"] + acc["p"]
        return F.struct((acc["p"] * rate / (k + 1)).alias("p"), total.alias("total"), F.when(total <= unit, k + 1).otherwise(acc["below"]).alias("below"))

    numbers = F.sequence(low, low + F.ceil(20 * F.sqrt(rate)).cast("long"))
    return F.when(rate > WIDE, F.aggregate(numbers, start, step, lambda acc: acc["below"]))


def repetition_rates(
    documents: DataFrame, weights: dict[str | None, float] | None = None, rest_weight: float = 1.0, epochs: float = 1.0
) -> DataFrame:
    """One row per source: source, n_docs, rate, cdf (null for rates over WIDE); weights are relative to each other."""
    sizes = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    weight = F.lit(float(rest_weight))
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    sizes = cut(sizes.withColumn("weight", weight))
    totals = sizes.agg(F.sum("n_docs").alias("all_docs"), F.sum("weight").alias("all_weights"))
    rate = F.when(F.col("all_weights") > 0, epochs * F.col("all_docs") * F.col("weight") / F.col("all_weights") / F.col("n_docs")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(totals)).select("source", "n_docs", rate.alias("rate")).withColumn("cdf", _distribution(F.col("rate")))


def replicate(
    documents: DataFrame,
    weights: dict[str | None, float] | None = None,
    rest_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """The documents with their number of copies in ``_tessera_copies``, of which there is at least one."""
    return _replicated(documents, cut(repetition_rates(documents.select("source"), weights, rest_weight, epochs)), seed, broadcast_sources)


def _replicated(documents: DataFrame, rates: DataFrame, seed: int, broadcast_sources: int) -> DataFrame:
    table = rates.select(F.col("source").alias("_tessera_source"), *[F.col(c).alias(f"_tessera_{c}") for c in _FACTS])
    same = F.col("source").eqNullSafe(F.col("_tessera_source"))
    if rates.count() <= broadcast_sources:
        joined = documents.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("_tessera_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        slot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)).cast("int")
        joined = documents.withColumn("_tessera_salt", slot).join(salted, same & (F.col("_tessera_salt") == F.col("_tessera_slot")))
        joined = joined.drop("_tessera_salt", "_tessera_slot")
    # the number is made of columns of both sides before it is compared, so that no filter on it moves below the join
    unit = hashed_unit(F.col("doc_id"), "copies", seed)
    below = F.array_position(F.array_sort(F.array_append("_tessera_cdf", unit)), unit) - 1
    counted = joined.withColumn("_tessera_copies", F.coalesce(below, _walked(unit, F.col("_tessera_rate"))))
    return counted.where("_tessera_copies > 0").drop("_tessera_source", *[f"_tessera_{c}" for c in _FACTS])


def _exploded(counted: DataFrame, rates: DataFrame, piece: int) -> DataFrame:
    """Each document once a copy, with the copy's number from 1. Where documents have many copies, pieces of these are dealt out first."""
    n = F.col("_tessera_copies")
    last = F.least(n, (F.col("_tessera_piece") + 1) * piece)
    pieces = counted.withColumn("_tessera_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / piece))))
    if (rates.agg(F.max("rate")).first()[0] or 0) > piece:
        pieces = pieces.repartition(F.col("_tessera_piece"), F.xxhash64("doc_id"))
    numbers = F.sequence((F.col("_tessera_piece") * piece + 1).cast("int"), last.cast("int"))
    return pieces.withColumn("_tessera_copy", F.explode(numbers)).drop("_tessera_copies", "_tessera_piece")


def mix(
    documents: DataFrame,
    weights: dict[str | None, float] | None = None,
    rest_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = SEED,
    copy_column: str | None = None,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Documents once per copy in a shuffled order.

    If copy_column is named, it holds the number of the copy, from 1, in place of a column of that name.
    """
    rates = cut(repetition_rates(documents.select("source"), weights, rest_weight, epochs))
    copies = _exploded(_replicated(documents, rates, seed, broadcast_sources), rates, PIECE)
    order = F.xxhash64(F.lit(seed), "doc_id", "_tessera_copy", F.lit("order"))
    shuffled = copies.withColumn("_tessera_order", order).repartition("_tessera_order").sortWithinPartitions("_tessera_order")
    shuffled = shuffled.drop("_tessera_order")
    if copy_column is None:
        return shuffled.drop("_tessera_copy")
    return shuffled.withColumn(copy_column, F.col("_tessera_copy")).drop("_tessera_copy")


#: Relative target weights of the query; sources that aren't named weigh 1.
TARGETS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def oracle_sql(targets: dict[str, float] = TARGETS, epochs: float = 1.0, seed: int = SEED, most: int = 100) -> str:
    """The rows of the query in DuckDB's SQL; counts the k with P(copies <= k) <= u for k up to most."""
    weight = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in targets.items()) + " ELSE 1.0 END"
    return f"""
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, CAST({weight} AS DOUBLE) AS w FROM documents GROUP BY source),
        rates AS (SELECT source, {epochs} * sum(n) OVER () * w / sum(w) OVER () / n AS rate FROM sizes),
        cdf(source, rate, k, p, total) AS (
          SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
          UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf WHERE k < {most}),
        u AS (SELECT *, ('0x' || substr(md5('copies:{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM documents),
        counted AS (SELECT u.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM u.source AND c.total <= u.u) AS n FROM u)
        SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INT) AS copy FROM counted WHERE n > 0"""
