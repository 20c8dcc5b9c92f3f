"""Counters and measures of filled and empty fields against gold labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType


def confusion(df: DataFrame, fields: dict[str, tuple[str, str]], tolerance: float = 0.01) -> DataFrame:
    """Per field (name -> gold column, predicted column): correct, wrong, missed, invented, correct_empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(g).cast("double").alias("g"), F.col(p).cast("double").alias("p")) for n, (g, p) in fields.items()]))
    long = df.select(pairs.alias("x")).select("x.*")
    same, g, p = F.abs(F.col("g") - F.col("p")) <= tolerance, F.col("g").isNotNull(), F.col("p").isNotNull()
    return long.groupBy("field").agg(
        F.count_if(g & p & same).alias("correct"), F.count_if(g & p & ~same).alias("wrong"), F.count_if(g & ~p).alias("missed"),
        F.count_if(~g & p).alias("invented"), F.count_if(~g & ~p).alias("correct_empty"),
    )


def precision_recall(counts: DataFrame, digits: int = 2) -> DataFrame:
    """Add precision, recall and f1 in percent; a wrong value counts against both; null where nothing can be divided."""
    def percent(c: Column) -> Column:
        return F.round(100 * c, digits)

    right = F.col("correct").cast("double")
    p = right / F.nullif(F.col("correct") + F.col("wrong") + F.col("invented"), F.lit(0))
    r = right / F.nullif(F.col("correct") + F.col("wrong") + F.col("missed"), F.lit(0))
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
    return counts.select("*", percent(p).alias("precision"), percent(r).alias("recall"), percent(f1).alias("f1"))


#: What can be said of one field of one record; a record's field that isn't measured has none of them.
OUTCOMES = ("correct", "wrong", "missed", "invented", "correct_empty")


def _equal(gold: Column, found: Column, kind: DataType, tolerance: float) -> Column:
    """Equality by the gold column's kind: numbers within the tolerance, anything else as it is."""
    if isinstance(kind, NumericType):
        return F.abs(gold.cast("double") - found.cast("double")) <= tolerance
    return gold == found.cast(kind)


def outcomes(df: DataFrame, fields: dict[str, tuple[str, str]], unstated: str | None = None, tolerance: float = 0.01, prefix: str = "") -> DataFrame:
    """df with a column (prefix and name) for each field (name -> gold column, found column): one of OUTCOMES, or null where it can't be measured.

    A gold value that is null says nothing unless its field's name is among the names in the column unstated (an array): then the source is
    known not to state it. Without that column every null is known.
    """
    out = {}
    for name, (gold, found) in fields.items():
        g, p = F.col(gold), F.col(found)
        known = F.coalesce(F.array_contains(F.col(unstated), F.lit(name)), F.lit(False)) if unstated else F.lit(True)
        same = F.coalesce(_equal(g, p, df.schema[gold].dataType, tolerance), F.lit(False))
        out[name] = F.when(g.isNull(), F.when(known, F.when(p.isNull(), "correct_empty").otherwise("invented"))).otherwise(
            F.when(p.isNull(), "missed").when(same, "correct").otherwise("wrong")
        )
    return df.select("*", *[c.alias(f"{prefix}{n}") for n, c in out.items()])


def evaluate(gold: DataFrame, extractor: Callable[[DataFrame], DataFrame], fields: dict[str, tuple[str, str]], unstated: str | None = None, tolerance: float = 0.01, digits: int = 2) -> DataFrame:
    """field, OUTCOMES, precision, recall, f1 of any extractor (a function that adds found columns to the gold rows).

    The last row, with a null field, sums the counts and has the mean of the fields' f1 that are known, as f1, in place of one of its own. Each
    row is extracted once; one aggregation counts all fields.
    """
    marks = [f"_outcome_{n}" for n in fields]
    told = outcomes(extractor(gold), fields, unstated, tolerance, "_outcome_")
    each = told.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(m).alias("o")) for m, n in zip(marks, fields, strict=True)])).alias("x"))
    found = each.groupBy("x.field").agg(*[F.count_if(F.col("x.o") == o).alias(o) for o in OUTCOMES])
    # fields without any row count too
    names = gold.sparkSession.createDataFrame([(n,) for n in fields], "field string")
    counts = names.join(found, "field", "left").na.fill(0, list(OUTCOMES))
    by_field = precision_recall(counts, digits)
    total = precision_recall(counts.agg(F.lit(None).cast("string").alias("field"), *[F.sum(o).alias(o) for o in OUTCOMES]), digits).drop("f1")
    macro = by_field.agg(F.round(F.avg("f1"), digits).alias("f1"))
    return by_field.unionByName(total.crossJoin(macro))


def first_converted(candidates: DataFrame, key: str, converters: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """key, field, value (as text), label, text, score: of a field's candidates (key, label, text, score) the most confident whose text converts.

    converters has for each label the field that it fills and how its text becomes a value, null where it doesn't; other labels are left out.
    Of equally confident candidates the first by label and text counts. Null scores rank last.
    """
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, (field, convert) in converters.items():
        name = F.when(F.col("label") == label, field).otherwise(name)
        value = F.when(F.col("label") == label, convert(F.col("text")).cast("string")).otherwise(value)
    rows = candidates.select(key, name.alias("field"), value.alias("value"), "label", "text", "score").where("field IS NOT NULL AND value IS NOT NULL")
    rank = F.struct((-F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("s"), "label", "text")
    best = rows.groupBy(key, "field").agg(F.min_by(F.struct("value", "label", "text", "score"), rank).alias("b"))
    return best.select(key, "field", "b.value", "b.label", "b.text", "b.score")
