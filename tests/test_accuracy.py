"""Evaluation of any extractor, and candidates that convert."""

from __future__ import annotations

from pyspark.sql import functions as F
from tessera.functions import numbers
from tessera.operators import accuracy


def test_kinds_flags_and_means(spark):
    rows = [
        (1, 1.89, "a", True, ["rate"]), (2, 2.0, None, None, ["name"]), (3, None, None, False, ["rate"]), (4, None, "b", None, None), (5, 3.0, "", True, []),
    ]
    gold = spark.createDataFrame(rows, "i int, rate double, name string, free boolean, unstated array<string>").withColumn("rate_found", F.lit("clash"))
    found = {1: (1.895, "a", True), 2: (2.5, None, None), 3: (0.5, "x", None), 4: (7.0, "B", True), 5: (None, "", True)}
    told = spark.createDataFrame([(k, *v) for k, v in found.items()], "i int, r double, n string, f boolean")
    fields = {"rate": ("rate", "r"), "name": ("name", "n"), "free": ("free", "f")}
    got = {r.field: tuple(r)[1:] for r in accuracy.evaluate(gold, lambda df: df.join(told, "i"), fields, "unstated").collect()}
    assert got["rate"] == (1, 1, 1, 1, 0, 33.33, 33.33, 33.33)
    assert got["name"] == (2, 1, 0, 0, 1, 66.67, 66.67, 66.67)
    assert got["free"] == (2, 0, 1, 0, 0, 100.0, 66.67, 80.0)
    assert got[None][:5] == (5, 2, 2, 1, 1) and got[None][7] == 60.0
    every = {r.field: r.invented for r in accuracy.evaluate(gold, lambda df: df.join(told, "i"), fields).collect()}
    assert every == {"rate": 2, "name": 1, "free": 1, None: 4}
    none = {r.field: (r.correct, r.f1) for r in accuracy.evaluate(gold.limit(0), lambda df: df.join(told, "i"), fields).collect()}
    assert none == {f: (0, None) for f in (*fields, None)}


def test_the_most_confident_that_converts(spark):
    rows = [
        (1, "oran", "yok", 0.9), (1, "oran", "%1,89", 0.7), (1, "oran", "%2", 0.6), (1, "tutar", "250 bin TL", None), (1, "other", "x", 1.0), (2, "oran", "belirsiz", 0.9),
        (3, "oran", "%3", 0.5), (3, "kar", "%4", 0.5), (None, "oran", "%5", 0.5), (4, "oran", None, 0.9),
    ]
    df = spark.createDataFrame(rows, "k int, label string, text string, score double")
    by = {"oran": ("rate", numbers.percent), "kar": ("rate", numbers.percent), "tutar": ("amount", numbers.amount)}
    got = {(r.k, r.field): (float(r.value), r.label) for r in accuracy.first_converted(df, "k", by).collect()}
    assert got == {(1, "rate"): (0.0189, "oran"), (1, "amount"): (250000.0, "tutar"), (3, "rate"): (0.04, "kar"), (None, "rate"): (0.05, "oran")}
