"""Numbers, dates and terms as Turkish texts write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, lower

# Names of months and multipliers, folded.
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")
MULTIPLIERS = {"bin": 1e3, "milyon": 1e6, "milyar": 1e9}


def percent(c: Column) -> Column:
    """The first number of up to three digits, comma or point as decimal sign, divided by 100; six digits."""
    found = F.replace(F.regexp_extract(c, r"(\d{1,3}(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    return F.round(found.try_cast("double") / 100, 6)


def amount(c: Column) -> Column:
    """An amount with points between thousands, a decimal comma and maybe a word for its magnitude.

    Four and more digits without points are one number, read whole.
    """
    pattern = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)\s*(bin|milyon|milyar)?\b"
    plain = fold(lower(c))
    number = F.replace(F.replace(F.regexp_extract(plain, pattern, 1), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    word, times = F.regexp_extract(plain, pattern, 2), F.lit(1.0)
    for name, value in MULTIPLIERS.items():
        times = F.when(word == name, value).otherwise(times)
    return number.try_cast("double") * times


def iso_date(c: Column) -> Column:
    """dd.mm.yyyy, dd/mm/yyyy or "dd month yyyy" at the start as yyyy-mm-dd; the calendar isn't checked."""
    plain = fold(lower(c))
    digits, words = r"^\s*(\d{1,2})[./](\d{1,2})[./](\d{4})", rf"^\s*(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(plain, words, 2)).cast("string")
    join = lambda d, m, y: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    part = lambda p, k: F.regexp_extract(plain, p, k)
    return F.when(plain.rlike(digits), join(part(digits, 1), part(digits, 2), part(digits, 3))).when(
        plain.rlike(words), join(part(words, 1), month, part(words, 3))
    )


def months(c: Column) -> Column:
    """A term in months: "n ay", else twelve times "n yıl" (also "yil")."""
    plain = fold(lower(c))
    found = lambda unit: F.regexp_extract(plain, rf"(\d+)\s*{unit}", 1).try_cast("int")
    return F.coalesce(found("ay"), found("yil") * 12)


def written(c: Column) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def written_short(c: Column) -> Column:
    """1234.5 as 1.234,5 and 5000 as 5.000: at most two decimals, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(written(c), "(,[0-9]*?)0+$", "$1"), ",$", "")


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def strict_number(c: Column) -> Column:
    """A plain number, maybe with a decimal point; null for anything else (percent signs, units, commas)."""
    return F.when(F.trim(c).rlike("^-?[0-9]+([.][0-9]+)?$"), F.trim(c).try_cast("double"))


def strict_date(c: Column) -> Column:
    """yyyy-mm-dd, maybe with a time after it, as a date of the calendar; else null."""
    return F.try_to_timestamp(F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[ T])"), F.substring(c, 1, 10)), F.lit("yyyy-MM-dd")).cast("date")


def day_gap(earlier: Column, later: Column) -> Column:
    """Days between two days, never below 0; null where one isn't a day."""
    return F.greatest(F.lit(0), F.date_diff(later, earlier))


def question_parameters(question: Column) -> dict[str, Column]:
    """principal, monthly rate in percent and months as a question states them; null where it doesn't."""
    plain = fold(lower(question))
    money = F.regexp_extract(plain, r"((?:[0-9]{1,3}(?:[.][0-9]{3})+|[0-9]+)(?:,[0-9]+)?(?:\s*(?:bin|milyon|milyar))?)\s*(?:tl|lira)", 1)
    rate = F.regexp_extract(plain, r"(?:%|yuzde)\s*([0-9]{1,2}(?:[.,][0-9]{1,4})?)", 1)
    return {
        "principal": amount(F.nullif(money, F.lit(""))),
        "rate_percent": F.replace(F.nullif(rate, F.lit("")), F.lit(","), F.lit(".")).try_cast("double"),
        "months": months(plain),
    }
