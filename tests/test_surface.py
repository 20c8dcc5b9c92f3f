"""Rules of extraction, verification, masking, sources and sinks on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tessera.functions import extraction, numbers, numerals
from tessera.functions import text as T
from tessera.operators import compare, complaints, phrases, retrieval, verification
from tessera.sources import tables
from tessera.streaming import sinks

OFFERS = [
    ("Aylık kâr oranı %1,99 ile 120 aya varan vade.", {"rate": 1.99, "term": 120}),
    ("%2,5 kar payı, 3 ay ödemesiz dönem, 12 taksit", {"rate": 2.5, "deferral": 3, "instalments": 12}),
    ("KÂR PAYSIZ 2.500 TL'ye kadar Yedek Hesap", {"rate": None, "amount": 2500.0}),
    ("Vade farksız alışveriş, en fazla 500 TL ödül kazanın", {"rate": 0.0, "reward": 500.0}),
    ("Restoranda %10 iade", {"rate": None}),
    ("Sadece %3,1 oranla", {"rate": 3.1}),
    ("Kâr payı oranı %45", {"rate": None}),
    ("50.000 TL - 250.000 TL arası finansman", {"amount": 250000.0}),
    ("250 bin TL'ye kadar", {"amount": 250000.0}),
    ("Dosya masrafı alınmaz", {"fee": 0.0}),
    ("Tahsis ücreti 1.500 TL", {"fee": 1500.0}),
    ("01.03.2026 - 31.05.2026 tarihleri arasında", {"start": "2026-03-01", "end": "2026-05-31"}),
    ("Son gün 5 Mayıs 2026", {"start": None, "end": "2026-05-05"}),
    ("Aidatsız kart", {"fee": 0.0}),
    ("Sıfır komisyon oranı", {"fee": 0.0}),
    ("Bu işlemden komisyon alınmaz", {"fee": 0.0}),
    ("Masrafsız bankacılık", {"fee": None, "fee_text": "Masrafsız"}),
    ("500 TL değerinde alışveriş çeki", {"reward": 500.0}),
    ("750 TL'ye varan nakit iade", {"reward": 750.0}),
    ("1.000 ₺ hediye", {"reward": 1000.0}),
    ("60 aya kadar taşıt finansmanı", {"term": 60, "instalments": None}),
    ("12 aya varan taksit", {"term": None, "instalments": 12}),
    ("tahsis ücreti: 1.500 ₺", {"fee": 1500.0}),
    ("tahsis ücreti tutarın binde 5'i", {"fee": None, "fee_text": "tahsis ücreti tutarın binde 5"}),
    ("dosya masrafı karşılanmaktadır", {"fee": 0.0}),
    ("Kişi başı maksimum toplam 2.000 TL nakit ödül", {"reward": 2000.0}),
    ("vade süresi en çok 36 aydır", {"term": 36}),
    ("0 kâr paylı", {"rate": 0.0}),
    ("", {"rate": None, "amount": None, "end": None}),
    (None, {"rate": None, "fee": None}),
]


def test_fields_are_read_with_their_spans(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OFFERS)], "i int, text string").withColumn("rate", F.lit("clash"))
    got = {r.i: r for r in extraction.with_fields(rows, "text", "x_").collect()}
    for i, (text, want) in enumerate(OFFERS):
        for name, value in want.items():
            found = got[i][f"x_{name}"]
            assert (found["value"] if found else None) == value, (text, name, found)
            assert not found or found["span"] in text
    assert got[0]["x_rate"]["span"] == "%1,99" and got[3]["x_rate"]["span"] == "Vade farksız" and got[0]["x_rate"]["confidence"] == 0.9
    one = extraction.with_fields(rows.where("i = 0"), "text", "x_")
    names = ["rate", "amount", "term"]
    assert one.select(extraction.overall_confidence({n: F.col(f"x_{n}") for n in names})).first()[0] == 0.875


def test_numbers_are_dealt_by_what_follows_them(spark):
    text = "12 ay, 5 bin TL, 3 milyonluk, %4\u2028 5₺, 50 gr ve 7"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    numbers = numerals.numerals(numerals.marked(F.col("text")))
    got = [r.n for r in rows.select(numbers.alias("n")).collect()]
    assert [(x["written"], x["scale"], x["sign"]) for x in got[0]] == [("12", "", "ay"), ("5", "bin", "tl"), ("3", "", "mi"), ("4", "", "\u2028 "), ("5", "", "₺,"), ("50", "", "gr"), ("7", "", "")]
    assert got[1] == [] and got[2] is None
    # a number's own pattern isn't tried again for each of its columns: two passes over the text, one pattern for the word that multiplies
    plan = rows.select(numbers.alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("regexp_extract(") <= 4
    read = extraction.with_fields(rows.where("text > ''"), "text").first()
    assert (read["reward"]["value"], read["reward"]["unit"], read["reward"]["span"]) == (50.0, "Gram", "50 gr")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_claims_need_their_words_near(spark):
    told = lambda text, value, name: one(spark, verification.confirmed(F.lit(text), F.lit(value).cast("double"), name))
    assert told("Kâr payı oranı %1,99.", 1.99, "rate") and not told("Kâr payı vardır. Ücret 1,99 TL", 1.99, "rate")
    assert told("250 bin TL'ye kadar", 250000.0, "amount") and told("250.000 TL tutar", 250000.0, "amount")
    assert not told("Vade 120 ay", 12.0, "term") and told("yalnız 12,5 var", 12.5, "other") and told("x", None, "rate") is None
    forms = one(spark, verification.surface_forms(F.lit(1500.5)))
    assert "1500,5" in forms and "1.500,5" in forms


def test_layers_settle_by_lock_and_confidence(spark):
    rows = [(1, "f", "regex", 1.0, 0.85), (1, "f", "llm", 2.0, 0.99), (2, "f", "regex", 1.0, 0.6), (2, "f", "ner", 3.0, 0.7), (3, "f", "llm", 4.0, 0.1), (4, "f", "regex", None, 0.9)]
    got = {r.k: (r.value, r.layer, r.conflict) for r in verification.reconcile(spark.createDataFrame(rows, "k int, field string, layer string, value double, confidence double"), ["k"], ["regex", "ner", "llm"]).collect()}
    assert got == {1: (1.0, "regex", True), 2: (3.0, "ner", True), 3: (4.0, "llm", False)}


def test_masking_knows_marked_letters_and_checksums(spark):
    said = "mail ayşe@banka.com ya da çığ.öz@x.com bitti, TR330006100519786457841326 ve 10000000146, 12345678901; 0532 123 45 67"
    m = one(spark, T.masked(F.lit(said)))
    assert m.text == "mail [EPOSTA] ya da [EPOSTA] bitti, [IBAN] ve [TCKN], 12345678901; [TELEFON]"
    assert (m.n_email, m.n_iban, m.n_identity, m.n_phone, m.n_card, m.needs_person) == (2, 1, 1, 1, 0, True)
    assert one(spark, T.masked(F.lit("")))["needs_person"] is False


def test_numbers_dates_and_questions(spark):
    assert one(spark, numbers.written_short(F.lit(5000.0))) == "5.000" and one(spark, numbers.written_short(F.lit(1500.5))) == "1.500,5"
    assert one(spark, numbers.strict_number(F.lit("1,5"))) is None and one(spark, numbers.first_integer(F.lit("no 42"))) == 42
    asked = numbers.question_parameters(F.lit("500.000 TL, aylık %1,89, 10 yıl"))
    assert [one(spark, asked[k]) for k in ("principal", "rate_percent", "months")] == [500000.0, 1.89, 120]


def test_small_text_rules(spark):
    assert one(spark, T.title(F.lit("http://b/x"), F.lit("ana sayfa\nBu satır yirmi harften uzun"))) == "Bu satır yirmi harften uzun"
    assert one(spark, T.partial_name(F.lit("Yeni ve büyük konut fırsatı"))) == "Yeni büyük konut" and one(spark, T.partial_name(F.lit("iki kelime"))) is None
    assert one(spark, T.customer_kind(F.lit("Maaş müşterilerine"))) == "Maaş müşterisi"
    assert one(spark, T.titled_chunks(F.lit("Ana Sayfa\n" + "uzun satır " * 8), F.lit("Başlık"))) == ["Başlık\n" + ("uzun satır " * 8).strip()]
    assert one(spark, F.concat_ws(",", T.problems(F.lit("x" * 200), words=("vade", "oran")))) == "off_topic"
    assert one(spark, T.json_body(F.lit("hiç"), "v string")) is None


def test_complaints_in_one_flow(spark):
    campaigns = spark.createDataFrame([(1, "Alfa Bank", "Bahar kampanyası", "Worldpuan", None, None), (2, "Beta", "Güz indirimi", None, None, None)], "campaign_id long, bank string, name string, unit string, start date, end date")
    permits = spark.createDataFrame([("Site", "2026-01-01", None), ("Old", "2026-01-01", "2026-02-01")], "source string, approved string, expires string").selectExpr("source", "DATE(approved) approved", "DATE(expires) expires")
    rows = spark.createDataFrame(
        [(1, "site", "Alfa Bank bahar Worldpuan ödülüm yatmadı, a@b.com", None), (2, "old", "Beta güz", None), (3, "SITE", None, None), (4, "site", "0532 123 45 67 beni arayın", None), (5, None, "x", None)],
        "complaint_id long, source string, text string, day date",
    )
    got = {r.complaint_id: r for r in complaints.handled(rows, permits, campaigns, {"reward": ["odul yatmadi"]}, F.lit("2026-06-01").cast("date")).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1].theme, got[1].campaign_id, got[1].why) == ("reward", 1, "matched") and got[1].text.endswith("[EPOSTA]")
    assert (got[4].text, got[4].theme, got[4].campaign_id, got[4].why) == ("[TELEFON] beni arayın", None, None, "no_candidate") and got[3].text is None


def test_hosts_of_one_site(spark):
    pairs = [
        ("www.banka.com.tr", "cdn.banka.com.tr", True), ("www.bank-a.com.tr", "bank-b.com.tr", False), ("banka.com.tr", "banka.com.tr", True), ("a.example.com", "b.example.com", True),
        ("a.example.com", "evilexample.com", False), ("x.com", "", False), (None, "x.com", False), ("A.X.com", "b.x.COM", True), ("www.banka.com.tr", "localhost", False),
    ]
    got = spark.createDataFrame(pairs, "a string, b string, ok boolean").withColumn("got", T.same_site(F.col("a"), F.col("b")))
    assert got.where("got != ok").collect() == []


def test_at_least_two_of_the_picked_exist(spark):
    df = spark.range(5)
    assert [r.id for r in compare.in_given_order(df, "id", [3, 9, 1]).collect()] == [3, 1]
    for ids in ([3, 9], [], [3, 3]):
        with pytest.raises(ValueError, match="two"):
            compare.in_given_order(df, "id", ids)
    with pytest.raises(ValueError, match="more than"):
        compare.in_given_order(df, "id", list(range(20_000)))


def test_phrases_may_carry_suffixes(spark):
    themes = {"reward": ["odul yatmadi", "puan"], "fee": ["ucret kesildi"]}
    told = lambda text: one(spark, complaints.theme(F.lit(text), themes))
    assert told("Ödülüm  yatmadı ki")["name"] == "reward" and told("Ödülüm YATMADI, puanım yok")["confidence"] == 0.85
    assert told("ödül bana yatmadı") is None and told("Ücretler\nkesildiği için")["name"] == "fee" and told("") is None


@pytest.mark.parametrize("size", [1, 4])
def test_names_are_found_as_they_stand(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "GRAM", size)
    names = ["alfa bank", "beta", "x", "bank", "ab", "zeta bank"]
    texts = [(1, "alfa bank ya da beta"), (2, "alfabank ab"), (3, None), (4, ""), (5, "zeta bank zeta bank x"), (5, "beta")]
    rows = phrases.named(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([(n,) for n in [*names, None, "", "x"]], "n string"), "n")
    assert sorted(map(tuple, rows.collect())) == sorted({(k, n) for k, t in texts for n in names if t and n in t})


def test_complaints_match_one_campaign_or_none(spark):
    campaigns = spark.createDataFrame([(1, "Alfa Bank", "Bahar kampanyası", "Worldpuan", None, None), (2, "Alfa Bank", "Bahar fırsatı", None, None, None), (3, "Beta", "Güz indirimi", None, None, None)],
                                      "campaign_id long, bank string, name string, unit string, start date, end date")
    said = spark.createDataFrame([(1, "Alfa Bank bahar worldpuan yok", None), (2, "alfa bank bahar", None), (3, "beta güz", None), (4, "merhaba", None), (5, None, None)], "complaint_id long, text string, day date")
    got = {r.complaint_id: (r.campaign_id, r.why) for r in complaints.match_campaigns(said, campaigns).collect()}
    assert got == {1: (1, "matched"), 2: (None, "tie"), 3: (3, "matched"), 4: (None, "no_candidate"), 5: (None, "no_candidate")}


def test_passages_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "a b c d e f g"), (3, None), (4, "q short one"), (5, "a b c d e f gg h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "short"), (3, None), (4, "c d e f g h")], "item_id long, text string")
    assert sorted(map(tuple, retrieval.containing(docs, items, "doc_id", "item_id", "text").collect())) == [(1, 1), (1, 4), (2, 1), (4, 2), (5, 1)]


def test_criteria_are_a_whitelist(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="unknown criterion"):
        compare.ranked_by(df, {"rate": True}, "id; drop", "id")
    with pytest.raises(ValueError, match="unknown criterion"):
        compare.criterion_sql("t", ["id"], {"rate": True}, "x", "id")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "banks.json").write_text(json.dumps({"a": {"name": "Alfa"}, "b": {"name": "Beta"}}))
    assert sorted(map(tuple, tables.settings(spark, str(tmp_path / "banks.json")).collect())) == [("a", "Alfa"), ("b", "Beta")]
    (tmp_path / "permits.json").write_text(json.dumps([{"source": "S", "approved": "2026-01-01", "expires": None, "approver": "x", "document": "d"}, {"source": "T", "approved": "2026-01-01"}]))
    permits = tables.permits(spark, str(tmp_path / "permits.json"))
    assert [r.source for r in permits.collect()] == ["S"]
    assert tables.state(spark, str(tmp_path / "state")) is None
    tables.write_state(spark, str(tmp_path / "state"), {"n": 3})
    assert tables.state(spark, str(tmp_path / "state")) == {"n": 3}
    said = spark.createDataFrame([("s", "yaz a@b.com"), ("t", "x"), (None, "y")], "source string, text string")
    sinks.save_complaints(said, permits, F.lit("2026-06-01").cast("date"), str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [("s", "yaz [EPOSTA]")]
    docs = spark.createDataFrame([(1, "uzun bir satır " * 6), (2, "uzun bir satır " * 6), (3, None)], "id long, text string")
    sinks.write_index(docs, str(tmp_path / "index"), "id", "text", F.lit(None).cast("string"))
    assert spark.read.parquet(str(tmp_path / "index/chunks")).count() == 1 and spark.read.parquet(str(tmp_path / "index/postings")).count() == 2  # "bir" is a stop word
    assert "| 1 |" in sinks.markdown("R", {"ids": docs.select("id")})
    with pytest.raises(ValueError, match="over 1 rows"):
        sinks.markdown("R", {"ids": docs}, most=1)
    sinks.append_audit(said.withColumn("at", F.lit("2026-06-01").cast("date")), str(tmp_path / "audit"), F.col("at"))
    sinks.write_snapshots(spark.createDataFrame([("b", "2026-01-01T10", "t")], "banka string, erisim_zamani string, ham_metin string"), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 1
    sinks.write_manifest(docs.select("id"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 3


def test_texts_without_numbers_or_addresses_meet_no_mask(spark):
    texts = {
        "TR330006100519786457841326": "[IBAN]", "5400 6100-5197 8645": "[KART]", "10000000146": "[TCKN]", "a@b.co": "[EPOSTA]", "(532)123-45 67": "[TELEFON]", "5321234567 a@b.co": "[TELEFON] [EPOSTA]",
        "no 123456 and at": "no 123456 and at", "": "", None: None,
    }
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.mask(F.col("t")).alias("m"))
    assert {r.t: r.m for r in found.collect()} == texts
    assert T.DIGITS in found._jdf.queryExecution().optimizedPlan().toString()
