"""Gold rows and the snapshots they were labelled from, by the last part of their address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece by which addresses meet; a shorter slug is its own piece.
PIECE = 8


def first_word(text: Column) -> Column:
    """The first word in lower case, without marks around it; null without a word."""
    word = F.regexp_extract(text, r"^[\s\p{Z}]*([^\s\p{Z}]+)", 1)
    return F.nullif(F.lower(F.replace(F.regexp_replace(word, "^[.,!?'’]+|[.,!?'’]+$", ""), F.lit("İ"), F.lit("i"))), F.lit(""))


def by_slug(gold: DataFrame, raw: DataFrame, key: str, one_page_banks: tuple[str, ...] = ()) -> DataFrame:
    """key, url, n_candidates of every gold row (key without repeats, bank, url, name): the snapshot (bank, url, text) of its bank
    whose url holds the last part of the row's url, the least url of several.

    Banks that show all offers on one page need more where several snapshots fit: the first word of the text's first line is
    that of the name. No slug, no bank or no such snapshot: null. Addresses meet by the rarest piece of PIECE characters of
    a slug and are then compared whole, so a bank's rows never meet all its snapshots.
    """
    slug = F.nullif(F.element_at(F.split(F.rtrim(F.col("url"), F.lit("/")), "/"), -1), F.lit(""))
    asked = gold.select(F.col(key).alias("_key"), F.col("bank").alias("_bank"), slug.alias("_slug"), first_word(F.col("name")).alias("_word"))
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    size = F.least(F.lit(PIECE), F.length("_slug"))
    parts = asked.where("_slug IS NOT NULL AND _bank IS NOT NULL").select("_key", "_bank", "_slug", "_word", F.explode(pieces(F.col("_slug"), size)).alias("_piece"))
    sizes = [r[0] for r in parts.select(F.length("_piece")).distinct().collect()]  # PIECE numbers at most
    pages = raw.select(F.col("bank").alias("_bank"), F.col("url").alias("_url"), first_word(F.substring_index(F.col("text"), "\n", 1)).alias("_first"))
    cut = F.flatten(F.array(*[F.when(F.length("_url") >= n, pieces(F.col("_url"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes]))
    spread = pages.where("_url IS NOT NULL AND _bank IS NOT NULL").select("*", F.explode(cut if sizes else F.array().cast("array<string>")).alias("_piece"))
    # Spark doesn't count that an address has many pieces, so it would broadcast those of all; they are sorted instead, which memory doesn't bound
    wanted = spread.join(parts.select("_bank", "_piece").distinct().hint("merge"), ["_bank", "_piece"], "left_semi")
    counts = wanted.groupBy("_bank", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = parts.join(counts.hint("merge"), ["_bank", "_piece"], "left").groupBy("_key", "_bank", "_slug", "_word").agg(
        F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("_piece")
    )
    met = rarest.join(wanted.hint("merge"), ["_bank", "_piece"]).where(F.contains("_url", "_slug"))
    fits = F.col("_first") == F.col("_word")
    found = met.groupBy("_key", "_bank").agg(F.count(F.lit(1)).alias("_n"), F.min("_url").alias("_any"), F.min(F.when(fits, F.col("_url"))).alias("_named"))
    one_page = F.col("_bank").isin(*one_page_banks) & (F.col("_n") > 1) if one_page_banks else F.lit(False)
    links = found.select("_key", F.when(one_page, F.col("_named")).otherwise(F.col("_any")).alias("url"), F.col("_n"))
    return asked.select("_key").join(links, "_key", "left").select(F.col("_key").alias(key), "url", F.coalesce("_n", F.lit(0)).alias("n_candidates"))
