"""Checking claims against their source text, and settling between layers of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerals
from ..functions.extraction import has_any, occurrences, plain_text
from ..functions.numbers import written_short

# A word of these must stand near a number for it to count as that field's; other fields need the number alone.
FIELD_WORDS = {
    "rate": ("kar pay", "kar oran", "vade farksiz", "karsiz"),
    "amount": ("finansman", "kredi tutar", "azami tutar", "maksimum tutar", "ust limit", "tutar", "arasi", "kadar"),
    "reward": ("odul", "hediye", "bonus", "kazan", "iade", "bankkart lira", "parafpara", "worldpuan", "mil", "puan", "cek"),
    "term": ("vade", "ay"), "instalments": ("taksit",), "deferral": ("erteleme", "odemesiz"), "fee": ("tahsis",),
}
REACH = 60
LOCK = 0.8


def surface_forms(value: Column) -> Column:
    """How a number may be written: four, two, one or no decimals with point or comma, points between thousands, "n bin"."""
    forms = []
    for digits in (4, 2, 1, 0):
        text = F.format_string(f"%.{digits}f", F.round(value, digits))
        forms += [F.when(F.abs(F.round(value, digits) - value) < 1e-9, x) for x in ((text, F.replace(text, F.lit("."), F.lit(","))) if digits else (text,))]
    forms.append(written_short(value))
    whole = (value >= 1000) & (F.pmod(value, F.lit(1000.0)) == 0)
    forms += [F.when(whole, F.concat(F.format_string("%.0f", value / 1000), F.lit(" bin")))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


#: Fields whose numbers are written without decimals.
WHOLE = ("term", "instalments", "deferral")


def candidates(value: Column, whole: bool = False) -> Column:
    """The numbers as which a value may be written: rounded to four, two, one and no decimals, of six digits that count at most; whole ones rounded alone."""
    if whole:
        return F.array(F.bround(value, 0))
    # digits before the point, so that six are written in all
    room = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1.0)))).cast("int"))
    rounded = [F.when(room >= d, F.bround(value, d)) for d in (4, 2, 1, 0)]
    return F.array_distinct(F.array_compact(F.array(*rounded, *[F.when(room == d, F.bround(value, d)) for d in (3, 2, 1)], F.bround(value, 0))))


def confirmed(text: Column, value: Column, field: str, reach: int = REACH) -> Column:
    """Whether the number stands by itself in text with one of the field's words near it in its sentence; null where value is null.

    Numbers are compared by value, rounded as they may be written. A sentence ends at any of .!? that isn't inside a number; a line's end is no boundary.
    """
    words, whole = FIELD_WORDS.get(field), field in WHOLE

    def stands(x: Column, meant: Column) -> Column:
        fits = F.exists(numerals.readings(x), lambda r: F.array_contains(meant, r["value"]) & (r["whole"] if whole else F.lit(True)))
        near = has_any(numerals.sentence(x, reach), words) if words else F.lit(True)
        return fits & numerals.alone(x) & near

    both = F.struct(numerals.numerals(numerals.marked(text)).alias("numbers"), candidates(value, whole).alias("meant"))
    there = F.transform(F.array(both), lambda c: F.exists(c["numbers"], lambda x: stands(x, c["meant"])))[0]
    return F.when(value.isNotNull(), F.coalesce(there, F.lit(False)))


def verify(claims: DataFrame, numbers: DataFrame, key: str, field: str, value: str, field_words: dict[str, tuple[str, ...]] | None = None, whole: tuple[str, ...] = WHOLE) -> DataFrame:
    """claims with found (the number stands in the key's text) and confirmed (with one of the field's words near it); both null for a null value.

    numbers is the table of functions.numerals.occurrences. It is reduced to one row for each key and value before the claims meet it, so
    that a text full of one number is no hot key; fields without words are confirmed by the number alone.
    """
    words = FIELD_WORDS if field_words is None else field_words
    flags = {name: F.bool_or(has_any(F.col("sentence"), near)) for name, near in words.items()}
    evidence = numbers.groupBy(F.col(key).alias("_key"), F.col("value").alias("_value"), F.col("whole").alias("_whole")).agg(
        F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])).alias("_near") if flags else F.expr("cast(array() as array<string>)").alias("_near")
    )
    plain = F.col(field).isin(*whole)
    meant = F.when(plain, candidates(F.col(value).cast("double"), True)).otherwise(candidates(F.col(value).cast("double")))
    asked = claims.withColumn("_id", F.monotonically_increasing_id()).select("*", F.explode_outer(F.when(F.col(value).isNotNull(), meant)).alias("_meant"))
    joined = asked.join(evidence, (F.col(key) == F.col("_key")) & (F.col("_meant") == F.col("_value")) & (F.col("_whole") | ~plain), "left")
    known = F.col(field).isin(*words) if words else F.lit(False)
    there = F.col("_key").isNotNull()
    sure = there & (~known | F.array_contains("_near", F.col(field)))
    out = joined.groupBy("_id", *claims.columns).agg(F.bool_or(there).alias("found"), F.bool_or(F.coalesce(sure, F.lit(False))).alias("confirmed"))
    told = lambda c: F.when(F.col(value).isNotNull(), F.col(c)).alias(c)
    return out.select(*claims.columns, told("found"), told("confirmed"))


def verification_summary(df: DataFrame, group: list[str], flags: dict[str, str]) -> DataFrame:
    """Per group and field (name -> column of true, false or null): confirmed, refuted, not_run, and the state of all three."""
    long = df.select(*group, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("ok")) for n, c in flags.items()])).alias("x")).select(*group, "x.*")
    out = long.groupBy(*group, "field").agg(F.count_if("ok").alias("confirmed"), F.count_if(~F.col("ok")).alias("refuted"), F.count_if(F.col("ok").isNull()).alias("not_run"))
    state = F.when(F.col("refuted") > 0, "refuted").when(F.col("confirmed") == 0, "not_run").when(F.col("not_run") > 0, "partly").otherwise("confirmed")
    return out.withColumn("state", state)


def reconcile(candidates: DataFrame, key: list[str], layers: list[str], lock: float = LOCK) -> DataFrame:
    """From candidates (key, field, layer, value, confidence) the value that stands, its layer, and whether layers differed.

    Layers speak in the given order; a later one takes over only with more confidence, and never once the standing
    value has at least lock. Null values say nothing. At most one candidate a layer counts: the most confident.
    """
    order = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    rows = candidates.where(F.col("value").isNotNull() & (order > 0)).groupBy(*key, "field", "layer").agg(
        F.max_by(F.struct("value", "confidence"), F.struct("confidence", "value")).alias("c")
    )
    said = rows.groupBy(*key, "field").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "layer", "c.value", "c.confidence"))).alias("said"))  # as many as layers
    standing = F.aggregate(
        F.slice("said", 2, len(layers)), F.element_at("said", 1),
        lambda held, new: F.when((held["confidence"] < lock) & (new["confidence"] > held["confidence"]), new).otherwise(held),
    )
    differ = F.exists("said", lambda x: ~x["value"].eqNullSafe(F.element_at("said", 1)["value"]))
    return said.select(*key, "field", standing.alias("s"), differ.alias("conflict")).select(*key, "field", "s.value", "s.layer", "s.confidence", "conflict")


def layer_contribution(standing: DataFrame, measured: list[str]) -> DataFrame:
    """Per layer how many fields it filled, and how many of them lie outside those measured."""
    return standing.groupBy("layer").agg(F.count(F.lit(1)).alias("filled"), F.count_if(~F.col("field").isin(measured)).alias("outside"))


def fill_nulls(stored: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """stored with null fields taken from new (one row a key), and filled, the number of fields that were."""
    found = new.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = stored.join(found, F.col(key) == F.col("_key"), "left")
    n = sum((F.col(f).isNull() & F.col(f"_{f}").isNotNull()).cast("int") for f in fields)
    rest = [F.col(c) for c in stored.columns if c not in fields]
    return joined.select(*rest, *[F.coalesce(f, f"_{f}").alias(f) for f in fields], n.alias("filled"))


def leaks(text: Column, root: str, suffixes: tuple[str, ...] = (), next_words: tuple[str, ...] = (), words_before: tuple[str, ...] = (), reach: int = 30) -> Column:
    """How often a root that should be another term begins a word, but for allowed suffixes, following words near it, and words right before."""
    plain = plain_text(text)
    places = occurrences(plain, rf"(?:^|[^a-z0-9_]){root}[a-z]*")

    def leaks_there(o: Column) -> Column:
        ending = F.substring_index(o["m"], root, -1)
        after = F.substr(plain, o["at"] + F.length(o["m"]), F.lit(reach))
        before = F.element_at(F.split(F.rtrim(F.substr(plain, F.lit(1), o["at"]), F.lit(" \n\t.,;:!?()")), r"\s"), -1)
        out = F.lit(True)
        for x in suffixes:
            out = out & ~ending.startswith(x)
        for x in next_words:
            out = out & ~after.rlike(rf"(?:^|[^a-z0-9_]){x}")
        return out & ~before.isin(*words_before) if words_before else out

    return F.size(F.filter(places, leaks_there))
