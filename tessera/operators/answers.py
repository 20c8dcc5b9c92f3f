"""Answers to questions in batches: every tool over the questions meant for it, and texts where a tool can't answer.

Each tool takes questions (a key without repeats, and a text) and returns one row a question: key, tool, ok, pick,
value, answer, reason, sources. pick names what the answer rests on; reason says why there is none. A null text has no answer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import written
from . import offers as O
from . import phrases, questions, retrieval
from .compare import first_qualifying
from .durable import cut

#: Axes of an offer, and whether less is better.
AXES = {"rate": True, "term": False, "fee": True, "reward": False}
AXIS_OF = {"en_dusuk_kar_payi": "rate", "en_uzun_vade": "term", "en_dusuk_masraf": "fee", "en_yuksek_odul": "reward"}


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name].cast("double")


def _result(df: DataFrame, key: str, tool: str, ok: Column, pick: Column, value: Column, answer: Column, reason: Column, sources: Column | None = None) -> DataFrame:
    """Columns of a tool's result; what isn't ok has no pick, value, answer or sources, what is has no reason."""
    sure = F.coalesce(ok, F.lit(False))
    told = [F.when(sure, c).alias(n) for n, c in (("pick", pick.cast("string")), ("value", value.cast("double")), ("answer", answer))]
    held = sources.cast("array<string>") if sources is not None else F.lit(None).cast("array<string>")
    return df.select(key, F.lit(tool).alias("tool"), sure.alias("ok"), *told, F.when(~sure, reason).alias("reason"), F.when(sure, held).alias("sources"))


def banks_named(asked: DataFrame, key: str, text: str, banks: DataFrame, name: str) -> DataFrame:
    """key, bank of the banks whose name a question holds, marks of letters aside; there may be any number of banks."""
    known = banks.where(F.length(F.trim(name)) > 0).select(F.col(name).alias("bank"), questions.plain(F.col(name)).alias("_plain")).distinct()
    said = asked.select(key, questions.plain(F.col(text)).alias("_said"))
    return phrases.named(said, key, "_said", known, "_plain").join(known, "_plain").select(key, "bank")


def calculated(asked: DataFrame, key: str, text: str) -> DataFrame:
    """The instalment of the amount, rate and term a question states."""
    rows = questions.with_calculation(asked.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").withColumnRenamed("_key", key)
    answer = _said("instalment ", written(F.col("instalment")), ", total ", written(F.col("total")), ", profit ", written(F.col("profit")))
    reason = F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", "))).otherwise("out of range")
    return _result(rows, key, "calculator", F.col("instalment").isNotNull(), F.col("months"), F.col("instalment"), answer, reason)


def defined(asked: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """The dictionary's entry for the term a question asks for. entries: position, key, variants, counterpart, meaning, origin."""
    rows = questions.look_up(asked.select(F.col(key).alias("_asked"), F.col(text).alias("_text")), "_text", entries).withColumnRenamed("_asked", key)
    known = entries.groupBy(F.col("key").alias("_entry")).agg(F.min_by(F.struct("counterpart", "meaning", "origin"), "position").alias("_e"))
    rows = rows.join(F.broadcast(known), F.col("entry") == F.col("_entry"), "left")  # as small as look_up() allows
    parts = [
        F.col("entry"), F.concat(F.lit("in other words "), F.nullif(F.col("_e.counterpart"), F.lit(""))), F.nullif(F.col("_e.meaning"), F.lit("")),
        F.concat(F.lit("(source: "), F.nullif(F.col("_e.origin"), F.lit("")), F.lit(")")),
    ]
    reason = _said("no entry near: ", F.coalesce("term", F.lit("")))
    return _result(rows, key, "dictionary", F.col("entry").isNotNull(), F.col("entry"), F.col("score"), F.concat_ws("; ", *parts), reason)


def bank_facts(offers: DataFrame) -> DataFrame:
    """One row a bank: number of offers, best value and its first offer on each axis, first and last unit of rewards, and
    classes: how many offers, and which one first, lead exactly the same axes of their bank (16 classes at most).

    offers: bank, offer, rate, term, fee, reward, unit. Aggregated before the shuffle; a large bank isn't gathered.
    """
    unit = F.when(F.col("reward").isNotNull(), F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("?")))
    best = {f"best_{a}": F.min(a) if low else F.max(a) for a, low in AXES.items()}
    rows = O.beside_group(offers.where("bank IS NOT NULL"), "bank", **best)
    mask = reduce(lambda x, y: x + y, [F.when(F.coalesce(F.col(a) == F.col(f"best_{a}"), F.lit(False)), 1 << i).otherwise(0) for i, a in enumerate(AXES)])
    classes = rows.withColumn("mask", mask).groupBy("bank", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.min("offer").alias("offer"), *[F.first(b).alias(b) for b in best], F.min(unit).alias("unit_a"), F.max(unit).alias("unit_b")
    )
    return classes.groupBy("bank").agg(
        F.sum("n").alias("n_offers"), *[F.first(b).alias(b) for b in best], F.min("unit_a").alias("unit_a"), F.max("unit_b").alias("unit_b"),
        F.sort_array(F.collect_list(F.struct("mask", "n", "offer"))).alias("classes"),
    )


def _with_banks(asked: DataFrame, key: str, text: str, banks: DataFrame, name: str, facts: DataFrame) -> DataFrame:
    """key, text, n_banks, b: the facts of the banks named, in the order of their names."""
    said = asked.select(F.col(key), F.col(text).alias("_text"))
    names = [c for c in facts.columns if c != "bank"]
    known = facts.select(F.col("bank").alias("_bank"), F.struct("bank", *names).alias("_facts"))
    named = banks_named(said, key, "_text", banks, name)
    met = named.join(known, F.col("bank") == F.col("_bank"), "left").groupBy(F.col(key).alias("_named")).agg(
        F.count(F.lit(1)).cast("int").alias("_n"), F.sort_array(F.collect_list("_facts")).alias("_b")
    )
    rows = said.join(met, F.col(key) == F.col("_named"), "left")
    return rows.select(key, "_text", F.coalesce("_n", F.lit(0)).alias("n_banks"), F.coalesce("_b", F.expr("array()").cast(met.schema["_b"].dataType)).alias("b"))


def compared(asked: DataFrame, key: str, text: str, banks: DataFrame, name: str, offers: DataFrame) -> DataFrame:
    """Which offer of the banks named is best by the question's criterion: the best value of one axis, the first offer of
    equals; or, for the most advantageous, the only offer with most axes on which it is best. Rewards of several units lead nothing there.
    """
    rows = _with_banks(asked, key, text, banks, name, bank_facts(offers))
    n = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["n_offers"])
    rows = rows.withColumn("_criterion", questions.criterion(F.col("_text"))).withColumn("_n", n)
    tops = {a: (F.array_min if low else F.array_max)(F.transform("b", _field(f"best_{a}"))) for a, low in AXES.items()}
    rows = rows.select("*", *[c.alias(f"_top_{a}") for a, c in tops.items()])
    units = F.array_union(F.transform("b", lambda x: x["unit_a"]), F.transform("b", lambda x: x["unit_b"]))
    rows = rows.withColumn("_one_unit", F.size(F.array_compact(units)) <= 1)

    flat = F.flatten(F.transform("b", lambda x: F.transform(x["classes"], lambda c: F.struct(
        F.lit(0).alias("wins"), c["n"].alias("n"), c["offer"].alias("offer"), x["bank"].alias("bank"), c["mask"].alias("mask"),
        *[x[f"best_{a}"].cast("double").alias(f"best_{a}") for a in AXES],
    ))))

    def best_of(i: int, axis: str) -> Callable[[Column], Column]:
        return lambda c: (c["mask"].bitwiseAND(F.lit(1 << i)) > 0) & F.coalesce(c[f"best_{axis}"] == F.col(f"_top_{axis}"), F.lit(False))

    def leads(c: Column, i: int, axis: str) -> Column:
        here = best_of(i, axis)(c)
        return here & F.col("_one_unit") if axis == "reward" else here

    scored = F.transform("_flat", lambda c: F.struct(
        reduce(lambda x, y: x + y, [leads(c, i, a).cast("int") for i, a in enumerate(AXES)]).alias("wins"), c["n"].alias("n"), c["offer"].alias("offer"), c["bank"].alias("bank"),
    ))
    rows = rows.withColumn("_flat", flat).withColumn("_scored", scored).withColumn("_most", F.array_max(F.transform("_scored", lambda c: c["wins"])))
    most = F.filter("_scored", lambda c: (c["wins"] == F.col("_most")) & (c["wins"] > 0))
    single = F.aggregate(most, F.lit(0).cast("long"), lambda a, c: a + c["n"]) == 1
    lead = {"en_avantajli": F.when(single, F.struct(most[0]["bank"].alias("bank"), most[0]["offer"].alias("offer"), F.col("_most").cast("double").alias("value")))}
    for i, axis in enumerate(AXES):
        there = F.filter("_flat", best_of(i, axis))
        first = F.array_min(F.transform(there, lambda c: F.struct(c["offer"].alias("offer"), c["bank"].alias("bank"))))
        criterion = next(k for k, v in AXIS_OF.items() if v == axis)
        lead[criterion] = F.when(first.isNotNull(), F.struct(first["bank"].alias("bank"), first["offer"].alias("offer"), F.col(f"_top_{axis}").alias("value")))
    chosen = reduce(lambda other, k: F.when(F.col("_criterion") == k, lead[k]).otherwise(other), lead, F.lit(None))
    rows = rows.withColumn("_lead", chosen)
    answer = F.when(F.col("_lead").isNull(), _said(F.col("_criterion"), ": no single leader")).otherwise(
        _said(F.col("_criterion"), ": ", F.col("_lead.bank"), ", offer ", F.col("_lead.offer").cast("string"), ", ", written(F.col("_lead.value")))
    )
    reason = F.when(F.col("n_banks") < 2, _said("banks named: ", F.greatest(F.col("n_banks"), F.lit(0)).cast("string"))).otherwise("fewer than two offers")
    return _result(rows, key, "sql", (F.col("n_banks") >= 2) & (F.col("_n") >= 2), F.col("_lead.bank"), F.col("_lead.value"), answer, reason)


def costed(asked: DataFrame, key: str, text: str, banks: DataFrame, name: str, offers: DataFrame) -> DataFrame:
    """Where the amount a question states costs least in all: of every bank named its first offer with rate (percent a month) and term."""
    first = first_qualifying(offers.select("bank", "offer", "rate", "term"), "bank", "offer", ["bank", "rate", "term"])
    rows = _with_banks(asked, key, text, banks, name, first.select("bank", "offer", "rate", "term"))
    rows = rows.withColumn("_p", questions.parameters(F.col("_text"))["principal"])
    flat = rows.select("*", F.explode_outer("b").alias("_x")).withColumn("_r", F.col("_x.rate") / 100).withColumn("_m", F.col("_x.term"))
    total = F.round(O.instalment("_p", "_r", "_m") * F.col("_m"), 2)
    flat = flat.withColumn("_total", total)
    one = flat.groupBy(key).agg(
        F.first("n_banks").alias("n_banks"), F.first("_p").alias("_p"), F.count("_x").alias("_n"), F.count("_total").alias("_sound"),
        F.sort_array(F.collect_list(F.when(F.col("_total").isNotNull(), F.struct(F.col("_total").alias("total"), F.col("_x.bank").alias("bank"))))).alias("_all"),
    )
    answer = F.array_join(F.transform("_all", lambda x: F.concat(x["bank"], F.lit(": "), written(x["total"]))), "; ")
    reason = F.when(F.col("n_banks") < 2, _said("banks named: ", F.greatest(F.col("n_banks"), F.lit(0)).cast("string"))).when(F.col("_p").isNull(), "missing: principal").when(
        F.col("_n") < 2, "rate or term missing"
    ).otherwise("out of range")
    ok = (F.col("n_banks") >= 2) & (F.col("_n") >= 2) & (F.col("_sound") == F.col("_n"))
    return _result(one, key, "calculator", ok, F.try_element_at("_all", F.lit(1))["bank"], F.try_element_at("_all", F.lit(1))["total"], answer, reason)


def from_texts(asked: DataFrame, key: str, text: str, chunks: DataFrame, doc: str, body: str, k: int = 3) -> DataFrame:
    """The k best texts as they are, numbered; no answer where they don't hold enough of the question's tokens."""
    said = asked.select(F.col(key), F.col(text).alias("_text"))
    held = retrieval.postings(chunks, doc, body)
    hits = retrieval.sparse_search(retrieval.postings(said, key, "_text"), held, key, doc, chunks.agg(F.count(F.lit(1)).alias("n")), k)
    bodies = hits.join(chunks.select(doc, F.col(body).alias("_body")), doc).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", doc, "_body", "score"))).alias("_hits"))
    rows = said.join(bodies, key, "left")
    lines = F.transform("_hits", lambda h: F.concat(h["position"].cast("string"), F.lit(". "), h["_body"]))
    enough = retrieval.sufficient(F.col("_text"), F.array_join(F.transform("_hits", lambda h: h["_body"]), " "))
    top = F.try_element_at("_hits", F.lit(1))
    return _result(rows, key, "rag", F.col("_hits").isNotNull() & enough, top[doc], top["score"], F.array_join(lines, "\n"), F.lit("no sufficient source"), F.transform("_hits", lambda h: h[doc].cast("string")))


def answered(asked: DataFrame, key: str, text: str, tools: dict[str, Callable[[DataFrame], DataFrame]], rag: Callable[[DataFrame], DataFrame], leak: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, intent, confidence, tool, ok, pick, value, answer, reason, sources, terms_hold: one row a question.

    tools has a function for each intent, rag one for the rest and for questions whose tool has no answer; if that has none
    either, the tool's reason stands. Intents and the tools' results are written once, as texts and the last join read them again. terms_hold: no leak in an answer put together from values; null for quoted and dictionary answers.
    """
    meant = cut(asked.select(key, text, questions.intent(F.col(text)).alias("_i")))
    parts = [tool(meant.where(F.col("_i.name") == name).select(key, text)) for name, tool in tools.items()]
    mine = lambda df, mark: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(mark))
    first = mine(reduce(DataFrame.unionByName, parts), "_a")
    left = cut(meant.join(first, key, "left"))
    quoted = mine(rag(left.where(~F.coalesce(F.col("_a.ok"), F.lit(False))).select(key, text)), "_b")
    rows = left.join(quoted, key, "left")
    by_tool, by_text = F.coalesce("_a.ok", F.lit(False)), F.coalesce("_b.ok", F.lit(False))
    used = F.when(by_tool | (~by_text & F.col("_a").isNotNull()), F.col("_a")).otherwise(F.col("_b"))
    rows = rows.withColumn("_u", used)
    reason = F.when(by_text & F.col("_a").isNotNull(), F.concat(F.col("_a.tool"), F.lit(" failed ("), F.col("_a.reason"), F.lit("), answered from texts"))).otherwise(F.col("_u.reason"))
    tool = F.when(F.col("_a").isNull() & ~by_text, "fallback").otherwise(F.col("_u.tool"))
    intent = F.when(by_text | F.col("_a").isNull(), "bilgi").otherwise(F.col("_i.name"))
    hold = F.when(F.col("_u.ok") & ~F.col("_u.tool").isin("rag", "dictionary"), ~leak(F.col("_u.answer"))) if leak else F.lit(None).cast("boolean")
    kept = [F.col(f"_u.{c}").alias(c) for c in ("ok", "pick", "value", "answer")]
    return rows.select(key, intent.alias("intent"), F.col("_i.confidence").alias("confidence"), tool.alias("tool"), *kept, reason.alias("reason"), F.col("_u.sources").alias("sources"), hold.alias("terms_hold"))
