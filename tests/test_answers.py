"""Questions answered by their tools, and from texts where those can't, on a small fixture; odd input; links by slug; sheets."""

from __future__ import annotations

from functools import partial

import pytest
from pyspark.sql import functions as F
from tessera.operators import answers, matching, phrases

OFFERS = [
    ("Ay Katılım", 1, 1.9, 24, 100.0, 500.0, "TL"), ("Ay Katılım", 2, 2.1, 36, None, None, None), ("Güneş", 3, 1.7, 12, 300.0, 900.0, "TL"),
    ("Güneş", 4, None, 48, 100.0, None, None), ("Yıldız", 5, None, None, None, 100.0, "Mil"), (None, 6, 0.1, 99, 0.0, 1.0, "TL"),
]
ENTRIES = [(0, "kar_payi", ["kâr payı"], "Faiz", "Ortakların payı.", "Tebliğ"), (1, "murabaha", ["Murabaha"], "", None, None)]
CHUNKS = [(10, "Altın günü kampanyası sürüyor"), (11, "Konut finansmanı için belge listesi"), (12, None)]
ASKED = {
    1: "500.000 TL %2 12 ay taksit", 2: "Ay Katılım ile Güneş: en düşük oran karşılaştır", 3: "Ay Katılım mı yoksa Güneş, en uzun vade?", 4: "Güneş, Ay Katılım: en avantajlı?",
    5: "Murabaha nedir?", 6: "Toplam maliyet 100.000 TL Ay Katılım Güneş", 7: "Altın günü taksit var mı", 8: "uzaydaki penguen sayısı", 9: None, 10: "", 11: "hangisi daha iyi Yıldız",
    12: "toplam maliyet Ay Katılım Güneş", 13: "Ay Katılım Güneş Yıldız en yüksek ödül hangisi daha iyi",
}


@pytest.fixture(scope="module")
def parts(spark):
    offers = spark.createDataFrame(OFFERS, "bank string, offer int, rate double, term int, fee double, reward double, unit string")
    entries = spark.createDataFrame(ENTRIES, "position int, key string, variants array<string>, counterpart string, meaning string, origin string")
    chunks = spark.createDataFrame(CHUNKS, "doc int, body string")
    return offers, offers.select("bank").distinct(), entries, chunks


def tools(parts):
    offers, banks, entries, chunks = parts
    of = {
        "hesaplama": partial(answers.calculated, key="q", text="text"), "sozluk": partial(answers.defined, key="q", text="text", entries=entries),
        "karsilastirma": partial(answers.compared, key="q", text="text", banks=banks, name="bank", offers=offers),
        "toplam_maliyet": partial(answers.costed, key="q", text="text", banks=banks, name="bank", offers=offers),
    }
    return of, partial(answers.from_texts, key="q", text="text", chunks=chunks, doc="doc", body="body")


def test_each_question_is_answered_once(spark, parts):
    asked = spark.createDataFrame(list(ASKED.items()), "q int, text string")
    got = {r.q: r for r in answers.answered(asked, "q", "text", *tools(parts), leak=lambda c: c.contains("faiz")).collect()}
    assert set(got) == set(ASKED)
    assert (got[1].tool, got[1].ok, got[1].terms_hold) == ("calculator", True, True) and abs(got[1].value - 47279.8) < 0.1
    assert (got[2].tool, got[2].pick, got[2].value) == ("sql", "Güneş", 1.7) and got[3].pick == "Güneş" and got[3].value == 48
    assert got[4].pick is None and got[4].ok and "no single leader" in got[4].answer  # offers 3 and 4 both lead two axes
    assert (got[5].tool, got[5].pick, got[5].terms_hold) == ("dictionary", "murabaha", None)
    assert (got[6].tool, got[6].pick) == ("calculator", "Güneş") and got[6].answer.startswith("Güneş: ")
    assert (got[7].intent, got[7].tool, got[7].sources) == ("bilgi", "rag", ["10"]) and "calculator failed" in got[7].reason and got[7].answer.startswith("1. Altın")
    for q in (8, 9, 10):
        assert (got[q].tool, got[q].ok, got[q].answer) == ("fallback", False, None) and got[q].reason == "no sufficient source"
    assert (got[11].tool, got[11].ok, got[11].reason) == ("sql", False, "banks named: 1")
    assert (got[12].ok, got[12].reason) == (False, "missing: principal")
    assert (got[13].pick, got[13].value) == ("Güneş", 900.0)


def test_the_most_advantageous_equals_a_plain_count(spark, parts):
    import random

    dice = random.Random(5)
    rows = [(f"banka{i % 4}", i, *[dice.choice([None, 1.0, 2.0, 3.0]) for _ in range(4)], dice.choice(["TL", "TL", " "])) for i in range(60)]
    offers = spark.createDataFrame(rows, "bank string, offer int, rate double, term double, fee double, reward double, unit string").repartition(5)
    sets = [[0, 1], [1, 2], [0, 3], [2, 3], [0, 1, 2, 3], [0]]
    few = offers.where("offer % 7 = 3 OR offer % 7 = 5")
    for frame, held in ((offers, rows), (few, [r for r in rows if r[1] % 7 in (3, 5)])):
        asked = spark.createDataFrame([(i, " ".join(f"banka{b}" for b in s) + " en avantajlı") for i, s in enumerate(sets)], "q int, text string")
        got = {r.q: r for r in answers.compared(asked, "q", "text", frame.select("bank"), "bank", frame).collect()}
        for i, s in enumerate(sets):
            mine = [r for r in held if int(r[0][5:]) in s]
            one_unit = len({r[6].strip() or "?" for r in mine if r[5] is not None}) <= 1
            best = [f([r[2 + a] for r in mine if r[2 + a] is not None], default=None) for a, f in enumerate((min, max, min, max))]
            wins = {r[1]: sum(r[2 + a] is not None and r[2 + a] == best[a] and (a < 3 or one_unit) for a in range(4)) for r in mine}
            top = [o for o, w in wins.items() if w == max(wins.values()) and w > 0]
            want = f"offer {top[0]}," if len(top) == 1 else "no single leader"
            assert got[i].ok == (len(s) > 1 and len(mine) > 1) and (not got[i].ok or want in got[i].answer), (i, got[i], wins)


def test_no_questions_and_no_banks(spark, parts):
    none = spark.createDataFrame([], "q int, text string")
    assert answers.answered(none, "q", "text", *tools(parts)).collect() == []
    offers, _, entries, chunks = parts
    bare = (offers.limit(0), offers.limit(0).select("bank"), entries.limit(0), chunks.limit(0))
    asked = spark.createDataFrame([(2, ASKED[2]), (5, ASKED[5]), (8, ASKED[8])], "q int, text string")
    assert all(not r.ok for r in answers.answered(asked, "q", "text", *tools(bare)).collect())


def test_lists_of_banks_may_be_long(spark):
    many = spark.range(3000).select(F.concat(F.lit("Banka "), "id").alias("n"))
    said = spark.createDataFrame([(1, "banka 17 ve BANKA 2999"), (2, "Bankaya"), (3, None), (4, "")], "k long, t string")
    got = {(r.k, r.bank) for r in answers.banks_named(said, "k", "t", many, "n").collect()}
    assert got == {(1, f"Banka {i}") for i in (1, 17, 2, 29, 299, 2999)}


def test_snapshots_are_found_by_slug(spark):
    gold = [
        (1, "a", "https://a.com/x/konut-finansmani/", "Konut"), (2, "a", "https://a.com/x/ev", "Ev"), (3, "b", "https://b.com/kampanyalar", "Özel Okul"), (4, "b", "https://b.com/kampanyalar", "Tatil"),
        (5, "a", "", "x"), (6, None, "https://a.com/x/ev", "x"), (7, "a", None, None), (8, "c", "https://c.com/konut-finansmani", "x"), (9, "b", "https://b.com/tekil-firsat", None),
    ]
    raw = [
        ("a", "https://www.a.com/tr/konut-finansmani-2?x", "Konut\nmetin"), ("a", "https://a.com/konut-finansmani", None), ("a", "https://a.com/evler", ""), ("b", "https://b.com/kampanyalar#1", "Restoran özel\nx"),
        ("b", "https://b.com/kampanyalar#2", "ÖZEL, okul\ny"), ("b", "https://b.com/tekil-firsat", None), (None, "https://a.com/ev", "x"), ("a", None, "x"),
    ]
    g, r = spark.createDataFrame(gold, "id int, bank string, url string, name string"), spark.createDataFrame(raw, "bank string, url string, text string")
    got = {x.id: (x.url, x.n_candidates) for x in matching.by_slug(g, r, "id", ("b",)).collect()}
    assert got == {
        1: ("https://a.com/konut-finansmani", 2), 2: ("https://a.com/evler", 1), 3: ("https://b.com/kampanyalar#2", 2), 4: (None, 2), 5: (None, 0), 6: (None, 0), 7: (None, 0), 8: (None, 0),
        9: ("https://b.com/tekil-firsat", 1),
    }
    assert matching.by_slug(g.limit(0), r, "id").count() == 0 and {x.url for x in matching.by_slug(g, r.limit(0), "id").collect()} == {None}


def test_names_are_broadcast_and_never_the_runs_of_all_texts(spark, monkeypatch):
    texts = spark.range(60).selectExpr("id AS q", "concat('said of name', id, ' and name', id % 7, 'x') AS t")  # fewer than names, as Spark sees it
    names = spark.range(3000).selectExpr("concat('name', id) AS n").union(spark.sql("SELECT 'id'"))
    said = {r.q: r.t for r in texts.collect()}
    want = {(q, n) for q, t in said.items() for n in [f"name{i}" for i in range(3000)] + ["id"] if n in t}
    for most in (phrases.BROADCAST, 0):
        monkeypatch.setattr(phrases, "BROADCAST", most)
        found = phrases.named(texts, "q", "t", names, "n")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0)
        assert {tuple(r) for r in found.collect()} == want


def test_pieces_of_addresses_are_never_broadcast(spark):
    gold = spark.range(30).selectExpr("id AS k", "'b' AS bank", "concat('http://x/', id, '-firsati') AS url", "'Ad' AS name")
    raw = spark.range(30).selectExpr("'b' AS bank", "concat('http://b/', id, '-firsati/detay') AS url", "'Metin' AS text")
    found = matching.by_slug(gold, raw, "k")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 4  # wanted pieces are read twice
    assert {r.k: r.n_candidates for r in found.collect()} == {i: sum(f"{i}-firsati" in f"http://b/{j}-firsati/detay" for j in range(30)) for i in range(30)}
