"""Nearest entry of a dictionary by the ratio of matching blocks, without comparing every phrase with every form.

The ratio of two strings is 2 M / (n + m), M the characters of their matching blocks. Where it reaches a least value L, three things
hold, and only pairs for which they do are made:

* the shorter has at least L / (2 - L) of the longer's length;
* they share at least M >= L (n + m) / 2 characters, counted with repetition;
* between two blocks one side has an unmatched character, so at least 3 M - (n + m) - 1 pairs of neighbours are shared. That is one or
  more from a summed length of 2 / (1.5 L - 1).

So a string emits its rarest tokens (characters if a partner may be short, pairs of neighbours if one may be long), all but as many as
any partner must share, and equal tokens are joined. The exact ratio is computed for the pairs that remain.

Null phrases and forms have no row; an empty string meets nothing; phrases count once however often they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut


def _long_from(least: float) -> float:
    """The summed length from which two strings of that ratio share a pair of neighbours."""
    return 2 / (1.5 * least - 1) if least > 2 / 3 else math.inf


def _numbered(parts: Column) -> Column:
    """Each part with the number of equal ones before it, so that sets stand for multisets."""
    return F.transform(parts, lambda x, i: F.concat(x, F.lit("\0"), F.size(F.filter(F.slice(parts, 1, i), lambda y: y == x)).cast("string")))


def _tokens(strings: DataFrame, name: str, least: float) -> DataFrame:
    """name, n (length), kind, token, drop: the tokens under which a string may meet others, and how many of the commonest need not be joined."""
    short = least / (2 - least)  # a partner's length, at least, as a share of this one's
    n = F.length(name)
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    # the parts are named before they are numbered, else each would be made again for every other
    base = strings.select(name, n.alias("n"), letters.alias("_l")).where("n > 0")
    base = base.withColumn("_p", F.when(F.col("n") > 1, F.transform(F.slice("_l", 1, F.col("n") - 1), lambda x, i: F.concat(x, F.element_at("_l", i + 2)))).otherwise(F.array()))
    edge = 1e-9
    shared = F.ceil(least * F.col("n") * (1 + short) / 2 - edge)
    least_pairs = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * F.col("n") * (1 + short) - 1 - edge))
    sets = []
    limit = _long_from(least)
    # with partners so short that the sum stays below the limit, and with others
    may_be_short = F.col("n") * (1 + short) < limit if limit < math.inf else F.lit(True)
    sets.append(F.when(may_be_short, F.struct(F.lit("c").alias("kind"), _numbered(F.col("_l")).alias("tokens"), (shared - 1).cast("int").alias("drop"))))
    if limit < math.inf:
        may_be_long = F.col("n") * (1 + 1 / short) >= limit
        sets.append(F.when(may_be_long, F.struct(F.lit("p").alias("kind"), _numbered(F.col("_p")).alias("tokens"), (least_pairs - 1).cast("int").alias("drop"))))
    out = base.select(name, "n", F.explode(F.array_compact(F.array(*sets))).alias("_s"))
    return out.select(name, "n", "_s.kind", "_s.drop", F.explode("_s.tokens").alias("token"))


def _rarest(tokens: DataFrame, often: DataFrame, name: str) -> DataFrame:
    """name, n, kind, token of the tokens that must be joined: all but the commonest drop ones of each string."""
    counted = tokens.join(often, ["kind", "token"], "left")
    sets = counted.groupBy(name, "n", "kind", "drop").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("_f"), "token"))).alias("_t"))
    return sets.select(name, "n", "kind", F.explode(F.slice("_t", 1, F.greatest(F.size("_t") - F.col("drop"), F.lit(0)))).alias("_x")).select(name, "n", "kind", "_x.token")


def candidates(phrases: DataFrame, forms: DataFrame, phrase: str, form: str, least: float) -> DataFrame:
    """phrase, form: the distinct pairs that may have a ratio of at least least."""
    mine, other = _tokens(phrases.select(phrase).distinct(), phrase, least), cut(_tokens(forms.select(form).distinct(), form, least))
    often = other.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("_f"))
    a = _rarest(mine, often, phrase)
    b = _rarest(other, often, form).withColumnRenamed("n", "m")
    near = (F.least("n", "m") * (2 - least) >= F.greatest("n", "m") * least - 1e-9)
    limit = _long_from(least)
    fits = F.when(F.col("kind") == "c", F.col("n") + F.col("m") < limit).otherwise(F.col("n") + F.col("m") >= limit) if limit < math.inf else F.lit(True)
    return a.join(b, ["kind", "token"]).where(near & fits).select(phrase, form).distinct()


def _ratios(phrase: str, form: str, least: float):
    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = SequenceMatcher(None)
        for batch in batches:
            kept, scores, last = [], [], None
            for i, (a, b) in enumerate(zip(batch[phrase], batch[form], strict=True)):
                if b != last:
                    matcher.set_seq2(b)
                    last = b
                matcher.set_seq1(a)
                if matcher.quick_ratio() >= least and (score := matcher.ratio()) >= least:
                    kept.append(i)
                    scores.append(score)
            yield batch.iloc[kept].assign(score=pd.Series(scores, index=batch.index[kept], dtype=float))

    return ratios


def alike(phrases: DataFrame, forms: DataFrame, phrase: str, form: str, least: float) -> DataFrame:
    """phrase, form, score: all pairs whose ratio of matching blocks is at least least, which lies above 0."""
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and not above 1")
    pairs = candidates(phrases, forms, phrase, form, least)
    # equal forms follow each other in a task, as what the matcher knows of a form is kept
    dealt = pairs.repartition(form, phrase).sortWithinPartitions(form)
    return dealt.mapInPandas(_ratios(phrase, form, least), f"`{phrase}` string, `{form}` string, score double")
