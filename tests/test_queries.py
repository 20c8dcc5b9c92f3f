"""The library's queries against their SQL, and rules that small fixtures show best."""

from __future__ import annotations

import json
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.functions import numbers
from tessera.functions import text as T
from tessera.operators import history, offers, retrieval, selection
from tessera.operators.ranking import rank_nulls_last
from tessera.plans import catalogue
from tessera.sources import raw
from tessera.streaming import ingest

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    frame = catalogue.queries()[name](spark, DATA)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    result = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = Counter(tuple(plain(v) for v in row) for row in result.fetchall())
    assert Counter(tuple(plain(v) for v in row) for row in frame.select(*names).collect()) == want


def test_nulls_rank_last_both_ways(spark):
    df = spark.createDataFrame([(1, 1.89), (2, 1.95), (3, 1.87), (4, None)], "id int, rate double")
    for descending, order in ((False, [3, 1, 2, 4]), (True, [2, 1, 3, 4])):
        assert [r.id for r in rank_nulls_last(df, "rate", ["id"], descending).orderBy("position").collect()] == order


def test_no_winner_is_invented(spark):
    df = spark.createDataFrame([("g", 1, 5.0, 10.0, "TL"), ("g", 2, 6.0, 12.0, "Mil"), ("h", 3, None, None, None)], "g string, id int, rate double, reward double, unit string")
    got = {r.id: (r.wins, r.winner) for r in offers.composite_winners(df, "g", {"rate": True, "reward": False}, ("reward", "unit")).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, False)}


def test_schedule_ends_at_zero_and_repays_all(spark):
    df = spark.createDataFrame([(1, 500000.0, 0.0189, 120), (2, 120000.0, 0.0, 12), (3, -1.0, 0.01, 12)], "id int, p double, r double, n int")
    rows = offers.schedule(df, "p", "r", "n").collect()
    assert {r.id for r in rows} == {1, 2}
    for i, p, n in ((1, 500000.0, 120), (2, 120000.0, 12)):
        mine = sorted((r for r in rows if r.id == i), key=lambda r: r.month)
        assert len(mine) == n and mine[-1].balance == 0 and math.isclose(sum(r.repaid for r in mine), p, abs_tol=1)


def test_versions_and_changes(spark):
    df = spark.createDataFrame([("u", "1", "a"), ("u", "2", "b"), ("v", "1", "a"), ("v", "2", "a")], "url string, ts string, hash string")
    got = {r.url: r.changed_hash for r in history.first_and_last(df, ["url"], ["ts"], ["hash"]).collect()}
    assert got == {"u": True, "v": False}
    new = spark.createDataFrame([("u", "b"), ("v", "c"), ("w", "a")], "url string, hash string")
    assert sorted(r.url for r in history.changed(new, history.latest(df, ["url"], ["ts"]), "url", "hash").collect()) == ["v", "w"]


def test_fusion_and_text(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, d int, position int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "q string, d int, position int")
    assert [r.d for r in retrieval.fuse(a, b, "q", "d", 3).orderBy("position").collect()] == [2, 1, 3]
    row = spark.range(1).select(
        T.fold(T.lower(F.lit("İNDİRİM ŞUBE Kâr"))).alias("f"), T.slug_title(F.lit("https://x.com/a/yeni-ev_firsati/?q=1")).alias("s"),
        T.mask(F.lit("yaz: a.b@c.com 4111 1111 1111 1111")).alias("m"), T.first_class(F.lit("konut finansman"), {"K": ["konut"], "F": ["finansman"]}).alias("c"),
    ).first()
    assert (row.f, row.s, row.m, row.c) == ("indirim sube kar", "Yeni Ev Firsati", "yaz: [EPOSTA] [KART]", "K")


def test_matrix_and_score(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 5.0), ("g", 2, 1.0, None), ("g", 3, 2.0, 4.0), (None, 4, None, None)], "g string, id int, rate double, fee double")
    rows = {r.id: r for r in offers.competitor_matrix(df, "g", {"rate": True, "fee": True}).collect()}
    assert {i: r.n_leads for i, r in rows.items()} == {1: 1, 2: 1, 3: 1, 4: 0}
    scores = {r.id: r.score for r in offers.financial_score(df, "g", {"rate": True, "fee": True}).collect()}
    assert scores == {1: 0.375, 2: None, 3: 0.5, 4: None}


def test_numbers_of_texts(spark):
    df = spark.createDataFrame([("%1,89", "1.500,50 TL", "31.02.2026", "24 ay"), ("yok", "250 Bin TL", "5 Şubat 2026", "2 YIL"), (None, None, None, None)], "p string, a string, d string, m string")
    got = df.select(numbers.percent(F.col("p")), numbers.amount(F.col("a")), numbers.iso_date(F.col("d")), numbers.months(F.col("m"))).collect()
    assert [tuple(r) for r in got[:2]] == [(0.0189, 1500.5, "2026-02-31", 24), (None, 250000.0, "2026-02-05", 24)]
    assert tuple(got[2]) == (None,) * 4
    assert spark.range(1).select(numbers.written(F.lit(1234.5))).first()[0] == "1.234,50"


def test_lines_are_packed_in_order(spark):
    text = "\n".join(["a" * 400, "b" * 250, "x", "c" * 300, "", "d" * 50])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.c for r in df.select("id", T.packed_lines(F.col("text")).alias("c")).collect()}
    assert got == {1: ["a" * 400 + " " + "b" * 250, "c" * 300 + " " + "d" * 50], 2: None, 3: []}


def test_split_has_no_small_group_in_test(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1), ("b", 2), (None, 7), (None, 8), (None, 9)], "g string, k int")
    got = Counter((r.g, r.part) for r in selection.stratified_split(df, "g", "k").collect())
    assert got == {("a", "test"): 20, ("a", "train"): 80, ("b", "train"): 2, (None, "test"): 1, (None, "train"): 2}


def test_snapshots_are_read_and_changes_stored_once(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"url": u, "erisim_zamani": t, "icerik_hash": h}) for u, t, h in rows))

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text('{"url": "u",\n "banka": "A"}')
    (tmp_path / "raw" / "b.json").write_text('{"url": ')
    assert [(r.url, r.banka) for r in raw.snapshots(spark, str(tmp_path / "raw")).collect()] == [("u", "A")]
    for name, rows in (("1.json", [("u", "1", "x"), ("u", "2", "x"), ("v", "1", "y")]), ("2.json", [("u", "3", "x"), ("v", "2", "z"), ("w", "1", "q")]), ("3.json", [("v", "3", "y")])):
        put(name, *rows)
        stream = spark.readStream.schema("url string, erisim_zamani string, icerik_hash string").json(str(tmp_path / "in"))
        ingest.store_changes(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.url, r.erisim_zamani) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("u", "1"), ("v", "1"), ("v", "2"), ("w", "1"), ("v", "3")}
