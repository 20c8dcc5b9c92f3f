"""Complaints: permits, themes and the campaign that a complaint is about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extraction import plain_text
from ..functions.text import masked
from . import phrases
from .durable import cut

# Weights of the match, least score, days after a campaign's end, and words that name no campaign.
BANK_WEIGHT, NAME_WEIGHT, UNIT_WEIGHT = 0.45, 0.35, 0.20
LEAST_SCORE, DAYS_AFTER = 0.5, 60
COMMON_WORDS = ("kampanya", "kampanyasi", "kampanyalari", "firsat", "firsati", "ozel", "yeni", "avantajli", "avantaj", "ile", "ve", "icin")
TIE = 1e-9


def permitted(rows: DataFrame, permits: DataFrame, source: str, today: Column) -> DataFrame:
    """Rows whose source has a permit (source, approved, expires) that holds today; expires may be null. A broken permit is none."""
    sound = permits.where(F.col("source").isNotNull() & (F.col("approved") <= today) & (F.col("expires").isNull() | (F.col("expires") >= today)))
    names = sound.select(F.lower("source").alias("_source")).distinct()
    return rows.join(names, F.lower(source) == F.col("_source"), "left_semi")


def theme(text: Column, themes: dict[str, list[str]]) -> Column:
    """struct(name, confidence) of the theme with most phrases in the text (inner words may have suffixes), the first of equals; one hit 0.6, more 0.85; null with none."""
    plain = plain_text(text)
    found = [
        F.struct(reduce(lambda a, b: a + b, [phrases.holds(plain, p).cast("int") for p in said]).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
        for i, (name, said) in enumerate(themes.items())
    ]
    best = F.array_max(F.array(*found))
    return F.when(best["hits"] > 0, F.struct(best["name"].alias("name"), F.when(best["hits"] > 1, 0.85).otherwise(0.6).alias("confidence")))


def words(text: Column) -> Column:
    """The distinct folded words of at least three letters, without those that name nothing."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(plain_text(text), F.lit("[a-z0-9]{3,}"), F.lit(0))), F.array(*map(F.lit, COMMON_WORDS)))


def match_campaigns(complaints: DataFrame, campaigns: DataFrame) -> DataFrame:
    """complaint_id, campaign_id, score, why: the campaign that a complaint (complaint_id, text, day) is about.

    Campaigns have campaign_id, bank, name, unit, start, end. Bank named 0.45, share of the name's words 0.35, unit named 0.2; a
    complaint before the start or over 60 days after the end rules a campaign out, null days never do. Two best of equal
    score, or less than 0.5, match nothing. Only pairs with a word in common are scored (a score of 0.5 takes bank or name words,
    and banks are words here), so complaints meet campaigns by words, never all by all.
    """
    c = complaints.select("complaint_id", "day", plain_text(F.col("text")).alias("said"), words(F.col("text")).alias("c_words"))
    g = campaigns.select("campaign_id", "start", "end", plain_text(F.col("bank")).alias("bank"), plain_text(F.col("unit")).alias("unit"), words(F.col("name")).alias("g_words"))
    keyed = g.withColumn("w", F.explode(F.array_distinct(F.concat("g_words", F.filter(F.array(F.regexp_extract("bank", "([a-z0-9]{3,})", 1)), lambda x: x != "")))))
    met = c.withColumn("w", F.explode("c_words")).select("complaint_id", "w").join(keyed.select("campaign_id", "w"), "w").select("complaint_id", "campaign_id").distinct()
    pairs = met.join(c, "complaint_id").join(g, "campaign_id")
    inside = F.coalesce(F.col("day") >= F.col("start"), F.lit(True)) & F.coalesce(F.col("day") <= F.date_add("end", DAYS_AFTER), F.lit(True))
    named = lambda x: F.coalesce(F.col("said").contains(F.nullif(F.col(x), F.lit(""))), F.lit(False)).cast("int")
    share = F.coalesce(F.size(F.array_intersect("g_words", "c_words")) / F.nullif(F.size("g_words"), F.lit(0)), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), BANK_WEIGHT * named("bank") + NAME_WEIGHT * share + UNIT_WEIGHT * named("unit")), 4)
    scored = pairs.where(inside).select("complaint_id", "campaign_id", score.alias("score"))
    best = scored.groupBy("complaint_id").agg(F.max("score").alias("best"), F.max_by("campaign_id", F.struct("score", -F.col("campaign_id"))).alias("campaign_id"))
    ties = scored.join(best.select("complaint_id", "best"), "complaint_id").groupBy("complaint_id").agg(F.count_if(F.abs(F.col("score") - F.col("best")) < TIE).alias("n"))
    out = complaints.select("complaint_id").join(best, "complaint_id", "left").join(ties, "complaint_id", "left")
    why = F.when(F.col("best").isNull() | (F.col("best") <= 0), "no_candidate").when(F.col("n") > 1, "tie").when(F.col("best") < LEAST_SCORE, "low_score").otherwise("matched")
    return out.select("complaint_id", F.when(why == "matched", F.col("campaign_id")).alias("campaign_id"), F.coalesce("best", F.lit(0.0)).alias("score"), why.alias("why"))


def handled(rows: DataFrame, permits: DataFrame, campaigns: DataFrame, themes: dict[str, list[str]], today: Column) -> DataFrame:
    """complaint_id, text, needs_person, theme, confidence, campaign_id, score, why of each complaint (complaint_id, source, text, day) whose source is permitted.

    One flow: the permit comes first, so that nothing of other sources is read on; the text is masked, and theme and campaign are found in
    what is left. The masked texts are written once, to the shared folder; what was said as it was never is. Repeated ids are complaints of one id.
    """
    allowed = permitted(rows, permits, "source", today)
    clean = cut(allowed.select("complaint_id", "day", masked(F.col("text")).alias("_m")).select("complaint_id", "day", "_m.text", "_m.needs_person"))
    met = match_campaigns(clean.select("complaint_id", "text", "day"), campaigns)
    met = met.groupBy(F.col("complaint_id").alias("_id")).agg(F.max_by(F.struct("campaign_id", "score", "why"), F.struct("score", "campaign_id")).alias("_c"))
    said = clean.withColumn("_t", theme(F.col("text"), themes)).join(met, F.col("complaint_id").eqNullSafe(F.col("_id")), "left")
    return said.select("complaint_id", "text", "needs_person", F.col("_t.name").alias("theme"), F.col("_t.confidence").alias("confidence"), "_c.campaign_id", "_c.score", "_c.why")
