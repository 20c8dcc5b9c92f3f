"""Phrases in texts: patterns whose inner words may carry suffixes, and names of any number met by a join on their rarest letters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut

#: Letters of a key under which names meet texts; shorter names meet under their own.
GRAM = 4
#: Letters of names and their keys up to which they are broadcast.
BROADCAST = 1 << 20


def phrase_pattern(phrase: str) -> str:
    """The pattern of a folded phrase: each word but the last may go on with a suffix; words stand one after the other."""
    return r"[\p{L}\p{N}_]*\s+".join(re.escape(w) for w in phrase.split())


def holds(plain: Column, phrase: str) -> Column:
    """Whether a folded text holds a phrase, suffixes of its inner words aside."""
    return plain.rlike(phrase_pattern(phrase)) if len(phrase.split()) > 1 else plain.contains(phrase.strip())


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of size letters of a text."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))


def named(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key, name: the names that a text holds, both folded already and compared letter by letter; there may be any number of names.

    A name is keyed by the one of its runs of GRAM letters that fewest names have, so that names with a common word don't meet every text with
    it; a text meets the names under its own runs, and the whole name is looked for in the pairs. Null and empty texts and names have none.
    Names alone are broadcast, and only few; with more of them both sides are shuffled, without the texts. Rows without a key have none.
    """
    held = names.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct()
    size = F.least(F.length("_name"), F.lit(GRAM))
    runs = held.select("_name", F.explode(_grams(F.col("_name"), size)).alias("_gram"))
    often = runs.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keyed = cut(runs.join(often, "_gram").groupBy("_name").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram")))
    letters, lengths = keyed.agg(F.sum(F.length("_name") + GRAM), F.collect_set(F.length("_gram"))).first()  # GRAM lengths at most
    said = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL AND length(_text) > 0")
    sizes = [F.when(F.length("_text") >= n, _grams(F.col("_text"), n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    own = said.select("_key", "_text", F.explode(F.flatten(F.array(*sizes)) if sizes else F.array().cast("array<string>")).alias("_gram"))
    # Spark doesn't count that texts have many runs, so it would broadcast those of all texts: which side goes where is said here
    if (letters or 0) <= BROADCAST:
        met = own.join(F.broadcast(keyed), "_gram")
    else:
        pairs = own.select("_key", "_gram").join(keyed.hint("merge"), "_gram").select("_key", "_name").distinct()
        met = pairs.join(said.hint("merge"), "_key")
    return met.where(F.contains("_text", "_name")).select(F.col("_key").alias(key), F.col("_name").alias(name)).distinct()
