"""Numbers where they stand in a text: found in one pass, with their value, unit and the words around them.

Rules of extraction and checks of claims read these instead of searching the text again for every form or field.
All reads the folded lower-case text, as long as the text itself, in which points inside numbers are marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import MULTIPLIERS
from .text import fold, lower

#: A point between digits, as marked; characters kept on either side of a number; digits beyond which a number has no value.
POINT, REACH, DIGITS = "․", 80, 40
#: Characters of a text that one row of the table of numbers covers while it is made.
BLOCK = 8192
_TOKEN = rf"[0-9]++(?:[{POINT},][0-9]++)*+"
#: What \s stands for in patterns.
SPACE = " \t\n\x0b\f\r"


def marked(text: Column) -> Column:
    """The folded lower-case text with points inside numbers marked."""
    return F.regexp_replace(fold(lower(text)), "(?<=[0-9])[.](?=[0-9])", POINT)


def numerals(plain: Column) -> Column:
    """array<struct<at, n, written, before, after, scale, rest, sign>> of a marked text, in order.

    at (from 1) and n are the number's place and length; before and after up to REACH characters beside it; scale a word that
    multiplies it, or empty, rest what follows that word (or the number), and sign the first two characters of rest behind white space.
    """
    # an array of one holds the text while its numbers are looked at, else it would be made again for each
    return F.transform(F.array(plain), _numerals_of)[0]


def _numerals_of(plain: Column) -> Column:
    kind = "array<struct<at:int,n:int,written:string,before:string,after:string>>"
    none = F.struct(F.lit(1).alias("next"), F.expr(f"cast(array() as {kind})").alias("met"))

    def add(acc: Column, x: Column) -> Column:
        end, n = acc["next"] + F.length(x["piece"]), F.length(x["written"])
        start = F.greatest(F.lit(1), end - n - REACH)
        before, after = F.substr(plain, start, end - n - start), F.substr(plain, end, F.lit(REACH))
        one = F.struct((end - n).alias("at"), n.alias("n"), x["written"], before.alias("before"), after.alias("after"))
        return F.when(n > 0, F.struct(end.alias("next"), F.array_append(acc["met"], one).alias("met"))).otherwise(acc)

    # a piece ends with a number; the last one, behind all numbers, is taken too, else it would be tried from each of its places
    pieces, tokens = (F.regexp_extract_all(plain, F.lit(f"[^0-9]*+({_TOKEN}|$)"), F.lit(group)) for group in (0, 1))
    both = F.zip_with(pieces, tokens, lambda piece, written: F.struct(piece.alias("piece"), written.alias("written")))
    found = F.aggregate(both, none, add, lambda acc: acc["met"])
    words = "|".join(MULTIPLIERS)

    def scaled(x: Column) -> Column:
        # what is named twice here is made twice, so the pattern is tried only where one of the words may follow
        sign = lambda c: F.left(F.ltrim(c, F.lit(SPACE)), F.lit(2))
        taken = F.regexp_extract(x["after"], rf"^\s*(?:{words})(?![\p{{L}}\p{{N}}_])", 0)
        rest = F.substr(x["after"], F.length(taken) + 1)
        with_scale = lambda scale, rest: F.struct(*[x[c] for c in ("at", "n", "written", "before", "after")], scale.alias("scale"), rest.alias("rest"), sign(rest).alias("sign"))
        return F.when(sign(x["after"]).isin(*{w[:2] for w in MULTIPLIERS}), with_scale(F.trim(taken), rest)).otherwise(with_scale(F.lit(""), x["after"]))

    return F.transform(found, scaled)


def value(x: Column) -> Column:
    """An amount: points part thousands, a comma decimals, and the word that multiplies counts; null for other writings."""
    whole = F.regexp_like(x["written"], F.lit(f"^(?:[0-9]{{1,3}}(?:{POINT}[0-9]{{3}})+|[0-9]+)(?:,[0-9]+)?$"))
    times = F.lit(1.0)
    for word, by in MULTIPLIERS.items():
        times = F.when(x["scale"] == word, by).otherwise(times)
    return F.when(whole, F.translate(x["written"], f",{POINT}", ".").try_cast("double") * times)


def decimal(x: Column) -> Column:
    """A number with up to two digits before and four behind a comma or point, as rates are written; null for others."""
    own = F.regexp_like(x["written"], F.lit(f"^[0-9]{{1,2}}(?:[{POINT},][0-9]{{1,4}})?$"))
    return F.when(own, F.translate(x["written"], f",{POINT}", "..").try_cast("double"))


def alone(x: Column) -> Column:
    """Whether no letter, digit or sign of numbers touches it; signs that end a sentence may follow."""
    return F.regexp_like(x["before"], F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_.,{POINT}])$")) & F.regexp_like(x["after"], F.lit(r"^[.,]*(?:$|[^\p{L}\p{N}_.,])"))


def readings(x: Column) -> Column:
    """array<struct<value, whole>>: what numbers are written so: whole as digits, in thousands or with "bin", others by decimals without a zero at the end."""
    w = x["written"]
    digits = F.regexp_like(w, F.lit("^(?:0|[1-9][0-9]*)$")) & (x["n"] <= DIGITS)
    thousands = F.regexp_like(w, F.lit(f"^[1-9][0-9]{{0,2}}(?:(?:{POINT}[0-9]{{3}})+|(?:,[0-9]{{3}})+)$")) & (x["n"] <= DIGITS)
    decimals = F.regexp_like(w, F.lit(f"^(?:0|[1-9][0-9]*)[{POINT},][0-9]{{0,3}}[1-9]$")) & (x["n"] <= DIGITS)
    plain = F.translate(w, f",{POINT}", "").try_cast("double")
    read = lambda ok, v, whole: F.when(ok, F.struct(v.alias("value"), F.lit(whole).alias("whole")))
    return F.array_compact(F.array(
        read(digits | thousands, plain, True), read(decimals, F.translate(w, f",{POINT}", "..").try_cast("double"), False), read(digits & (x["scale"] == "bin"), plain * 1000, True),
    ))


def sentence(x: Column, reach: int) -> Column:
    """The number with up to reach characters on either side, as far as its sentence goes; .!? end one, a line's end doesn't."""
    return F.concat(F.regexp_extract(F.right(x["before"], F.lit(reach)), "[^.!?]*$", 0), x["written"], F.regexp_extract(F.left(x["after"], F.lit(reach)), "^[^.!?]*", 0))


def occurrences(texts: DataFrame, key: str, text: str, reach: int = 60, block: int = BLOCK) -> DataFrame:
    """key, position, written, value, whole, sentence: every number that stands alone, once for each reading, from one pass over the texts.

    position counts characters from 1; written and sentence are as folded. A text is read in blocks that overlap by what stands around a
    number, so a very long one costs no more than many short ones. Null texts have none.
    """
    margin = REACH + DIGITS
    plain = texts.select(F.col(key), marked(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    start = F.explode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(block))).alias("_from")
    pieces = plain.select(key, "_t", start)
    first = F.greatest(F.lit(0), F.col("_from") - margin)
    pieces = pieces.select(key, "_from", first.alias("_first"), F.substr("_t", first + 1, F.col("_from") - first + block + margin).alias("_p"))
    x = F.col("_x")
    found = pieces.select(key, "_from", "_first", F.explode(numerals(F.col("_p"))).alias("_x"))
    at = F.col("_first") + x["at"]
    own = found.where((at > F.col("_from")) & (at <= F.col("_from") + block) & (x["n"] <= DIGITS) & alone(x))
    rows = own.select(key, at.alias("position"), F.replace(x["written"], F.lit(POINT), F.lit(".")).alias("written"), F.explode(readings(x)).alias("_r"), sentence(x, reach).alias("_s"))
    return rows.select(key, "position", "written", "_r.value", "_r.whole", F.replace("_s", F.lit(POINT), F.lit(".")).alias("sentence"))
