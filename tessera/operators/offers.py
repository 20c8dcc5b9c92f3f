"""Comparing offers: axis winners, percentiles with half ties, lifecycle, instalments.

Facts of a group are aggregated before the shuffle and joined back, so a hot group is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside_group(df: DataFrame, group: str, **facts: Column) -> DataFrame:
    """Add to each row the given aggregates of its group; null is a group of its own."""
    found = df.groupBy(F.col(group).alias("_group")).agg(*[c.alias(name) for name, c in facts.items()])
    return df.join(found, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def _best(axes: dict[str, bool]) -> dict[str, Column]:
    return {f"_best_{a}": F.min(a) if low else F.max(a) for a, low in axes.items()}


def _leads(axis: str) -> Column:
    return F.coalesce(F.col(axis) == F.col(f"_best_{axis}"), F.lit(False))


def composite_winners(df: DataFrame, group: str, axes: dict[str, bool], unit: tuple[str, str] | None = None) -> DataFrame:
    """Add wins: on how many axes (column -> lower is better) a row has its group's best value.

    Nulls never win and ties all win. The axis unit[0] counts only where its column unit[1], blank as "?",
    has one value in the group. ``winner`` marks the row with most wins if it is the only one with any.
    """
    facts = _best(axes)
    if unit:
        name = F.when(F.col(unit[0]).isNotNull(), F.coalesce(F.nullif(F.trim(F.col(unit[1])), F.lit("")), F.lit("?")))
        facts["_one_unit"] = F.min(name) == F.max(name)
    won = F.lit(0)
    for axis in axes:
        hit = _leads(axis) & F.col("_one_unit") if unit and axis == unit[0] else _leads(axis)
        won = won + F.coalesce(hit, F.lit(False)).cast("int")
    scored = beside_group(df, group, **facts).withColumn("wins", won).drop(*facts)
    scored = beside_group(scored, group, _tally=F.max("wins"))
    scored = scored.withColumn("_is_top", (F.col("wins") == F.col("_tally")) & (F.col("_tally") > 0))
    return beside_group(scored, group, _n_top=F.count_if("_is_top")).withColumn("winner", F.col("_is_top") & (F.col("_n_top") == 1)).drop("_tally", "_is_top", "_n_top")


def competitor_matrix(df: DataFrame, group: str, axes: dict[str, bool]) -> DataFrame:
    """Add lead_<axis> for each axis (column -> lower is better), ties leading alike, and n_leads."""
    out = beside_group(df, group, **_best(axes))
    for axis in axes:
        out = out.withColumn(f"lead_{axis}", _leads(axis)).drop(f"_best_{axis}")
    return out.withColumn("n_leads", sum((F.col(f"lead_{a}").cast("int") for a in axes), F.lit(0)))


def half_tie_percentile(df: DataFrame, group: str, value: str, low_is_better: bool, name: str = "percentile", digits: int = 4) -> DataFrame:
    """Add the percentile: (worse + half of the other equals) / (n - 1) over the group's non-null values; null if n < 2.

    Only the counts of distinct values are ordered within a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_group"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    worse_first = F.col("_value").desc() if low_is_better else F.col("_value").asc()
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy(worse_first).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select("*", upto.alias("_upto"), F.sum("_n").over(Window.partitionBy("_group")).alias("_all"))
    share = (F.col("_upto") - F.col("_n") + F.lit(0.5) * (F.col("_n") - 1)) / F.nullif(F.col("_all") - 1, F.lit(0))
    joined = df.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col(value) == F.col("_value")), "left")
    return joined.withColumn(name, F.round(share, digits)).drop("_group", "_value", "_n", "_upto", "_all")


def financial_score(df: DataFrame, group: str, axes: dict[str, bool], least_peers: int = 3, least_axes: int = 2, digits: int = 4) -> DataFrame:
    """Add score: the mean of the axes' known percentiles; null with fewer peers in the group or fewer known axes."""
    out = beside_group(df, group, _peers=F.count(F.lit(1)))
    marks = [f"_p_{a}" for a in axes]
    for (axis, low), mark in zip(axes.items(), marks, strict=True):
        out = half_tie_percentile(out, group, axis, low, mark)
    known = sum((F.col(m).isNotNull().cast("int") for m in marks), F.lit(0))
    mean = sum((F.coalesce(m, F.lit(0.0)) for m in marks), F.lit(0.0)) / F.nullif(known, F.lit(0))
    return out.withColumn("score", F.when((F.col("_peers") >= least_peers) & (known >= least_axes), F.round(mean, digits))).drop("_peers", *marks)


def affordable_principal(payment: str, monthly_rate: str, months: str) -> Column:
    """The principal that a monthly payment repays; null where rate or months are out of range."""
    a, r, n = (F.col(c).cast("double") for c in (payment, monthly_rate, months))
    growth = F.pow(1 + r, n)
    return F.when((a > 0) & (n > 0) & (n <= 480) & r.between(0, 0.2), F.when(r == 0, a * n).otherwise(a * (growth - 1) / F.nullif(r * growth, F.lit(0.0))))


def cheapest(df: DataFrame, group: str, key: str, cost: str) -> DataFrame:
    """Per group the key with the least cost, ties by key, and that cost; null costs never win."""
    known = df.where(F.col(cost).isNotNull())
    return known.groupBy(group).agg(F.min_by(key, F.struct(cost, key)).alias(key), F.min(cost).alias(cost))


def lifecycle(start: str, end: str, today: Column) -> Column:
    """EXPIRED, ACTIVE or BILINMIYOR from the two dates and a given day."""
    s, e = F.col(start), F.col(end)
    return F.when(e < today, "EXPIRED").when(s > today, "BILINMIYOR").when(e >= today, "ACTIVE").when(s.isNotNull() & e.isNull(), "ACTIVE").otherwise("BILINMIYOR")


def instalment(principal: str, monthly_rate: str, months: str) -> Column:
    """The annuity's instalment; null where an input is out of range (P in (0, 1e8], n in (0, 480], r in [0, 0.2])."""
    p, r, n = (F.col(c).cast("double") for c in (principal, monthly_rate, months))
    growth = F.pow(1 + r, n)
    value = F.when(r == 0, p / n).otherwise(p * r * growth / F.nullif(growth - 1, F.lit(0.0)))
    return F.when((p > 0) & (p <= 1e8) & (n > 0) & (n <= 480) & r.between(0, 0.2), value)


def schedule(df: DataFrame, principal: str, monthly_rate: str, months: str, digits: int = 2) -> DataFrame:
    """One row per month: month, interest, repaid, balance; the last month clears the rest.

    The balance after k months is P * g^k - pay * (g^k - 1) / r with g = 1 + r, so months are rows of their own and no state is carried.
    """
    p, r, n = (F.col(c).cast("double") for c in (principal, monthly_rate, months))
    rows = df.withColumn("_pay", instalment(principal, monthly_rate, months)).where("_pay IS NOT NULL")
    rows = rows.withColumn("month", F.explode(F.sequence(F.lit(1), F.col(months).cast("int"))))

    def balance(k: Column) -> Column:
        growth = F.pow(1 + r, k)
        return F.when(r == 0, p - F.col("_pay") * k).otherwise(p * growth - F.col("_pay") * (growth - 1) / F.nullif(r, F.lit(0.0)))

    last = F.col("month") == n
    before = balance(F.col("month") - 1)
    after = F.when(last, F.lit(0.0)).otherwise(balance(F.col("month")))
    return rows.select(*df.columns, "month", F.round(before * r, digits).alias("interest"), F.round(before - after, digits).alias("repaid"), F.round(after, digits).alias("balance"))
