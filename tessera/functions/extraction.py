"""Fields of an offer from its text, each with the words it was read from and a confidence.

Rules about numbers read the text's numbers (functions.numerals), found in one pass with the words around them; the others read the folded
lower-case text. Both are as long as the text itself, so that a span is cut from it as it was written. Numbers are dealt once by the sign that
stands beside them, and a pattern is tried only where a word stands without which it can't match: most of the time went into such patterns. A field is struct(value, span, confidence), null where no rule finds it: missing, never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numerals
from .numbers import MONTHS, iso_date
from .text import fold, lower

# Context words that a percentage must not stand near to be a rate, words of rewards and of spending.
FEE_WORDS = ("ucret", "masraf", "komisyon", "vergi", "bsmv", "kkdf", "pesinat", "ekspertiz", "tahsis", "indirim", "stopaj", "maliyet", "iade", "odul", "kazan", "hediye", "puan", "makas", "kur")
REWARD_WORDS = ("odul", "hediye", "bonus", "kazan", "iade", "bankkart lira", "parafpara", "worldpuan", "puan", "cek")
SPEND_WORDS = ("harca", "alisveris")
# Units of rewards by the word that names them.
UNITS = {"bankkart lira": "Bankkart Lira", "parafpara": "ParafPara", "worldpuan": "Worldpuan"}

# Reach of the words near a rate, near a cap and near a reward's limit, in characters; percentages that may be rates.
RATE_REACH, CAP_REACH, LIMIT_REACH = 45, 60, 80
LEAST_RATE, MOST_RATE = 0, 15

DATE = rf"[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}|[0-9]{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+[0-9]{{4}}"
TRACE = "span string, confidence double"


def plain_text(text: Column) -> Column:
    return fold(lower(text))


class Folded:
    """A folded text's column, and intermediate columns that several rules read, each computed once a row.

    Columns of a level may read those of the levels below.
    """

    def __init__(self, name: str) -> None:
        self.c, self.name, self.levels = F.col(name), name, ({}, {}, {}, {})

    def keep(self, column: Column, level: int) -> Column:
        name = f"{self.name}_{level}_{len(self.levels[level])}"
        self.levels[level][name] = column
        return F.col(name)


def part(plain: Folded, pattern: str, group: int = 1, text: Column | None = None, words: tuple[str, ...] = (), level: int = 0) -> Column:
    """The group of the first match in the folded text (or in one made from it), null without one; words: what every match holds one of."""
    text = plain.c if text is None else text
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return plain.keep(F.when(holds(text, *words), found) if words else found, level)


def cut_out(text: Column, plain: Folded, found: Column) -> Column:
    """What stands in text where found, a part of plain, is first met."""
    return F.substr(text, F.position(found, plain.c), F.length(found))


def occurrences(plain: Column, pattern: str) -> Column:
    """Every match and where it starts (from 1), in order."""
    none = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<struct<m:string,at:int>>)").alias("met"))

    def add(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, plain, acc["next"])
        return F.struct((at + F.length(m)).alias("next"), F.array_append(acc["met"], F.struct(m.alias("m"), at.alias("at"))).alias("met"))

    return F.aggregate(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), none, add, lambda acc: acc["met"])


def window(plain: Column, at: Column, size: Column, reach: int, own_sentence: bool = False) -> Column:
    """reach characters on either side of a match; clipped to its sentence (a break is one of .!? before white space) if wanted."""
    start = F.greatest(F.lit(1), at - reach)
    before, after = F.substr(plain, start, at - start), F.substr(plain, at + size, F.lit(reach))
    if own_sentence:
        before = F.element_at(F.split(before, r"[.!?]\s"), -1)
        after = F.element_at(F.split(after, r"[.!?]\s"), 1)
    return F.concat(before, F.lit(" "), after)


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words; one pattern, as the text is often made on the spot and would be made again for each word."""
    return F.regexp_like(c, F.lit("|".join(rf"\Q{w}\E" for w in words)))


def holds(c: Column, *words: str) -> Column:
    """has_any without a pattern, for texts that are there already."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def field(plain: Folded, value: Column, span: Column, confidence: float, **more: Column) -> Column:
    value = plain.keep(value, 3)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), *[c.alias(n) for n, c in more.items()], span.alias("span"), F.lit(confidence).alias("confidence")))


def plausible(percent: Column) -> Column:
    """A monthly rate, else null."""
    return F.when(percent.between(LEAST_RATE, MOST_RATE), percent)


def _length(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(text, pattern, 0))


class Numbers:
    """A text's numbers, and the first of them that a rule takes, with the text around it that belongs to the find."""

    def __init__(self, text: Column, plain: Folded) -> None:
        self.text, self.plain = text, plain
        self.all = plain.keep(numerals.numerals(F.regexp_replace(plain.c, "(?<=[0-9])[.](?=[0-9])", numerals.POINT)), 0)
        self.dealt: dict[tuple[str, ...], Column] = {}
        # signs behind which a line may end, too
        percent = lambda x: F.contains(x["before"], F.lit("%")) & F.endswith(F.rtrim(x["before"], F.lit(numerals.SPACE + "\x85\u2028\u2029")), F.lit("%")) & _precedes(x, "%")
        self.percents = plain.keep(F.when(holds(plain.c, "%"), F.filter(self.all, lambda x: percent(x) & numerals.decimal(x).isNotNull())), 1)

    def before(self, *signs: str) -> Column:
        """The numbers behind which one of the words may follow, by their first two characters; null if the text has none of the words."""
        if signs not in self.dealt:
            starts = lambda x: reduce(lambda a, b: a | b, [F.startswith(x["sign"], F.lit(w[:2])) for w in signs])
            self.dealt[signs] = self.plain.keep(F.when(holds(self.plain.c, *signs), F.filter(self.all, starts)), 1)
        return self.dealt[signs]

    def first(self, among: Column, takes, lead: str = "$", tail: str = "^", words: tuple[str, ...] = ()) -> tuple[Column, Column]:
        """The first of the numbers that takes() accepts, null without one, and its span: from where lead matches before it to where tail matches after it.

        words: one of them stands in every text that has such a number.
        """
        found = F.try_element_at(F.filter(among, lambda x: takes(x)), F.lit(1))
        x = self.plain.keep(F.when(holds(self.plain.c, *words), found) if words else found, 2)
        return x, self.span(x, lead, tail)

    def span(self, x: Column, lead: str = "$", tail: str = "^") -> Column:
        ahead = _length(x["before"], lead)
        own = x["n"] + F.length(x["after"]) - F.length(x["rest"])
        return F.substr(self.text, x["at"] - ahead, ahead + own + _length(x["rest"], tail))


def _near(x: Column, reach: int, own_sentence: bool = False) -> Column:
    """What stands within reach on either side of a number, as far as its sentence goes if wanted (its end is one of .!? before white space)."""
    before, after = F.right(x["before"], F.lit(reach)), F.left(x["after"], F.lit(reach))
    if own_sentence:
        before, after = F.element_at(F.split(before, r"[.!?]\s"), -1), F.element_at(F.split(after, r"[.!?]\s"), 1)
    return F.concat(before, F.lit(" "), after)


def _follows(x: Column, pattern: str) -> Column:
    return F.regexp_like(x["rest"], F.lit(f"^\\s*(?:{pattern})"))


def _precedes(x: Column, pattern: str) -> Column:
    return F.regexp_like(x["before"], F.lit(f"(?:{pattern})\\s*$"))


_LIRA, _LIRAS = "(?:tl|₺)(?![a-z])", ("tl", "₺")
_TO = r"['’]?\s*(?:[yae]{1,2}\s*)?"
_UP_TO = r"(?:a|e|ya|ye)?\s*(?:kadar|varan)?\s*"
_PROFIT = r"kar\s*(?:pay|oran)"


def rate(text: Column, plain: Folded, numbers: Numbers) -> Column:
    """The rate in percent: beside the words for it, else a phrase that means zero, else any percentage away from fees and rewards."""
    named = (
        lambda x: holds(x["after"], "kar") & F.regexp_like(F.left(x["after"], F.lit(40)), F.lit(rf"^[^%\n]{{0,25}}{_PROFIT}")),
        lambda x: holds(x["before"], "kar") & F.regexp_like(x["before"], F.lit(rf"{_PROFIT}[a-z]*[^%\n]{{0,25}}%\s*$")),
    )
    rules = []
    for beside in named:
        x, span = numbers.first(numbers.percents, beside, r"%\s*$", words=("kar",))
        rules.append(field(plain, plausible(numerals.decimal(x)), span, 0.9))
    own = F.when(holds(plain.c, "yedek hesap"), F.regexp_replace(plain.c, r"(?s)kar\s*paysiz.{0,60}?yedek hesap", "")).otherwise(plain.c)  # another product's rate
    none, none_span = numbers.first(numbers.before("kar"), lambda x: (x["written"] == "0") & _follows(x, r"kar\s*pay") & ~F.regexp_like(x["before"], F.lit("[a-z_]$")), "$", r"^\s*kar\s*pay[a-z]*", ("0",))
    free, vade = part(plain, r"(kar\s*paysiz)", text=own, words=("paysiz",)), part(plain, r"(vade\s*farksiz)", text=own, words=("farksiz",))
    zero = lambda found: F.when(found.isNotNull(), F.lit(0.0))
    rules += [field(plain, zero(free), cut_out(text, plain, free), 0.85), field(plain, zero(none), none_span, 0.85), field(plain, zero(vade), cut_out(text, plain, vade), 0.8)]
    x, span = numbers.first(numbers.percents, lambda x: plausible(numerals.decimal(x)).isNotNull() & ~has_any(_near(x, RATE_REACH), FEE_WORDS), r"%\s*$")
    return F.coalesce(*rules, field(plain, numerals.decimal(x), span, 0.6))


def financed_amount(text: Column, plain: Folded, numbers: Numbers) -> Column:
    """The upper end of a range, else the first cap that is no spending or reward."""
    upper, upper_span = numbers.first(numbers.before(*_LIRAS), lambda x: holds(x["rest"], "aras") & _follows(x, rf"{_LIRA}\s*aras") & _precedes(x, rf"[0-9]\s*(?:bin|milyon|milyar)?\s*(?:tl|₺)?\s*(?:-|–|ile)"), words=("aras",))
    cap, cap_span = numbers.first(numbers.before(*_LIRAS), lambda x: holds(x["rest"], "kadar") & _follows(x, rf"{_LIRA}{_TO}kadar") & ~has_any(_near(x, CAP_REACH, True), REWARD_WORDS + SPEND_WORDS), "$", rf"^\s*{_LIRA}{_TO}kadar", ("kadar",))
    return F.coalesce(field(plain, numerals.value(upper), upper_span, 0.85), field(plain, numerals.value(cap), cap_span, 0.75))


def _whole(plain: Folded, numbers: Numbers, rules: list[tuple], confidence: float = 0.85) -> Column:
    """An integer times a factor by the first rule that takes a number; the find holds both contexts.

    A rule is (digits, lead, tail, factor, among, *words): among holds the numbers that it may take, and one of words follows
    each that it takes. Every lead begins with "vade".
    """
    out = []
    for digits, lead, tail, times, among, *words in rules:
        short = lambda x, digits=digits: (x["n"] <= digits) & (x["scale"] == "") & F.regexp_like(x["written"], F.lit(f"^[0-9]{{1,{digits}}}$"))
        fits = lambda x, short=short, words=words, lead=lead, tail=tail: holds(x["rest"], *words) & short(x) & (holds(x["before"], "vade") & _precedes(x, lead) if lead else F.lit(True)) & _follows(x, tail)
        x, span = numbers.first(among, fits, f"(?:{lead})\\s*$" if lead else "$", f"^\\s*(?:{tail})", tuple(words))
        out.append(field(plain, x["written"].try_cast("int") * times, span, confidence))
    return F.coalesce(*out)


def term(text: Column, plain: Folded, numbers: Numbers) -> Column:
    """Months; instalments are no term."""
    lead, month, year = r"vade[a-z]*[^0-9.\n]{0,20}", numbers.before("ay"), numbers.before("yil")
    return _whole(plain, numbers, [
        (3, "", rf"ay{_UP_TO}(?:sabit\s*)?vade", 1, month, "vade"), (3, "", r"aylik\s*vade", 1, month, "aylik"),
        (3, "", r"aya?\s*(?:kadar|varan)\s*(?:konut|arac|tasit|ihtiyac)?\s*finansman[a-z]*", 1, month, "finansman"),
        (3, lead, r"ay(?!a?\s*(?:kadar|varan)?\s*taksit)", 1, month, "ay"), (2, "", rf"yil{_UP_TO}vade", 12, year, "vade"), (2, lead, "yil", 12, year, "yil"),
    ])


def deferral(text: Column, plain: Folded, numbers: Numbers) -> Column:
    return _whole(plain, numbers, [(2, "", r"ay[a-z]*\s*(?:varan|kadar)?\s*(?:ertele|otele|odemesiz)[a-z]*", 1, numbers.before("ay"), "ertele", "otele", "odemesiz")])


def instalments(text: Column, plain: Folded, numbers: Numbers) -> Column:
    return _whole(plain, numbers, [(3, "", r"(?:aya?|['’]?[ae])?\s*(?:varan|kadar)?\s*taksit[a-z]*", 1, numbers.all, "taksit")])


def reward(text: Column, plain: Folded, numbers: Numbers) -> Column:
    """struct(value, unit, span, confidence): miles, then grams, then money and points, then the largest capped amount of a reward's sentence."""
    unit = lambda found: reduce(lambda a, k: F.when(found.contains(k), UNITS[k]).otherwise(a), UNITS, F.lit("TL"))
    rules = []
    for name, word, tail in (("Mil", "mil", "mil(?![a-z])"), ("Gram", "gr", "(?:gram|gr)(?![a-z])")):
        x, span = numbers.first(numbers.before(word), lambda x, tail=tail: _follows(x, tail), "$", rf"^\s*{tail}")
        rules.append(field(plain, numerals.value(x), span, 0.8, unit=F.lit(name)))
    points = "|".join(UNITS)
    gift = rf"{_LIRA}{_TO}(?:degerinde|varan|kadar|lik)?\s*(?:nakit\s*|alisveris\s*)?(?:{'|'.join(REWARD_WORDS)})"
    x, span = numbers.first(numbers.before(*_LIRAS, *UNITS), lambda x: holds(x["rest"], *UNITS, *REWARD_WORDS) & _follows(x, f"{points}|{gift}"), "$", rf"^\s*(?:{points}|{gift})", (*UNITS, *REWARD_WORDS))
    rules.append(field(plain, numerals.value(x), span, 0.8, unit=unit(F.regexp_extract(x["rest"], rf"^\s*(?:{points}|{gift})", 0))))
    most = r"(?:en fazla|maksimum)\s+(?:[^\s]+\s+){0,4}"
    capped = lambda x: holds(x["before"], "en fazla", "maksimum") & (_precedes(x, "en fazla|maksimum") | F.regexp_like(x["before"], F.lit(most + "$"))) & _follows(x, _LIRA)
    limits = F.filter(numbers.before(*_LIRAS), lambda x: (capped(x) | holds(x["rest"], "sinirli") & _follows(x, rf"{_LIRA}['’]?\s*(?:ile\s*)?sinirli")) & has_any(_near(x, LIMIT_REACH, True), REWARD_WORDS))
    largest = F.array_max(F.transform(limits, lambda x: F.struct(numerals.value(x).alias("v"), (-x["at"]).alias("back"), x.alias("x"))))
    top = plain.keep(F.when(holds(plain.c, "en fazla", "maksimum", "sinirli"), largest), 2)
    end = rf"^\s*{_LIRA}(?:['’]?\s*(?:ile\s*)?sinirli)?"
    rules.append(field(plain, top["v"], numbers.span(top["x"], r"(?:en fazla|maksimum)\s*$", end), 0.7, unit=F.lit("TL")))
    return F.coalesce(*rules)


#: A fee named with what says that none is taken, and phrases that say so by themselves.
_NO_FEE = r"(?:(?:masraf|komisyon|tahsis ucret|ekspertiz ucret)[a-z]*[^.\n]{0,40}(?:alinm|karsilan|yok)[a-z]*|(?:dosya|tahsis|ekspertiz)\s*(?:masraf|ucret)siz[a-z]*|masrafsizlik[a-z]*|sifir\s*komisyon[a-z]*|aidatsiz)"


_FEES = ("masraf", "komisyon", "tahsis", "ekspertiz", "dosya", "aidatsiz")


def fee(text: Column, plain: Folded, numbers: Numbers) -> Column:
    """An allocation fee in money, else 0 where the text says that none is taken."""
    named = r"(?:dosya masraf[a-z]*|tahsis(?:\s*ucret)?[a-z]*|ekspertiz[a-z]*(?:\s*ucret[a-z]*)?)[^0-9%\n]{0,20}"
    x, span = numbers.first(numbers.before(*_LIRAS), lambda x: holds(x["before"], *_FEES) & _follows(x, _LIRA) & _precedes(x, named), rf"{named}$", rf"^\s*{_LIRA}", _FEES)
    free = part(plain, f"({_NO_FEE})", words=_FEES)
    return F.coalesce(field(plain, numerals.value(x), span, 0.85), field(plain, F.when(free.isNotNull(), F.lit(0.0)), cut_out(text, plain, free), 0.8))


def fee_text(text: Column, plain: Folded, numbers: Numbers) -> Column:
    """How a fee is described: a share of the amount, else that there is none, else a bare mention."""
    share = r"(?:tahsis|masraf)[^.\n]{0,60}(?:%|binde|yuzde)\s*"
    x, span = numbers.first(numbers.all, lambda x: holds(x["before"], "tahsis", "masraf") & F.regexp_like(x["before"], F.lit(f"{share}$")), f"{share}$", words=("tahsis", "masraf"))
    free, bare = part(plain, f"({_NO_FEE})", words=_FEES), part(plain, r"(masraf[a-z]*|tahsis ucret[a-z]*)", words=_FEES)
    told = lambda found: cut_out(text, plain, found)
    return F.coalesce(field(plain, F.when(x.isNotNull(), span), span, 0.8), field(plain, told(free), told(free), 0.8), field(plain, told(bare), told(bare), 0.5))


def period(text: Column, plain: Folded) -> tuple[Column, Column]:
    """Start and end from a range of dates; a single date is the end."""
    both = rf"({DATE})\s*(?:-|–|ile|ve)\s*({DATE})"
    whole = part(plain, both, 0)
    first, last = (part(plain, both, group, whole, level=1) for group in (1, 2))
    one = part(plain, rf"({DATE})", text=F.when(whole.isNull(), plain.c), level=1)  # a range's end is always a date
    start = field(plain, iso_date(first), cut_out(text, plain, whole), 0.9)
    end = F.coalesce(field(plain, iso_date(last), cut_out(text, plain, whole), 0.9), field(plain, iso_date(one), cut_out(text, plain, one), 0.85))
    return start, end


def extract(text: Column, plain: Folded) -> dict[str, Column]:
    """All fields by name; each a struct with value, span and confidence (reward with its unit). plain holds plain_text(text)."""
    start, end = period(text, plain)
    numbers = Numbers(text, plain)
    rules = {"rate": rate, "amount": financed_amount, "term": term, "deferral": deferral, "instalments": instalments, "reward": reward, "fee": fee, "fee_text": fee_text}
    return {name: rule(text, plain, numbers) for name, rule in rules.items()} | {"start": start, "end": end}


def with_fields(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add a column for each field; the text is folded once a row, and no pattern is matched twice."""
    plain = Folded("_plain")
    fields = extract(F.col(text), plain)
    out = df.withColumn("_plain", plain_text(F.col(text)))
    for level in plain.levels:
        out = out.withColumns(level)
    return out.select(*df.columns, *[c.alias(f"{prefix}{name}") for name, c in fields.items()])


def overall_confidence(fields: dict[str, Column]) -> Column:
    """The mean confidence of the fields found, 0 with none."""
    known = F.filter(F.array(*[f["confidence"] for f in fields.values()]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, F.round(total / F.size(known), 4)).otherwise(F.lit(0.0))
