"""Keyed state by buckets: what a batch writes, reads again and drops."""

from __future__ import annotations

import glob
import json

from pyspark.sql import functions as F
from tessera.streaming import ingest, sinks, state


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"url": u, "erisim_zamani": t, "icerik_hash": h}) for u, t, h in rows))

    def run():
        stream = spark.readStream.schema("url string, erisim_zamani string, icerik_hash string").json(str(tmp_path / "in"))
        ingest.store_changes(stream, str(tmp_path / "out"), str(tmp_path / "at"), buckets=16).awaitTermination(120)

    put("0.json", *[(f"u{i}", "1", f"h{i}") for i in range(200)])
    run()
    put("1.json", ("u3", "2", "h3"), ("u4", "2", "new"), ("fresh", "2", "x"))
    run()
    put("2.json", ("u4", "3", "new"), ("u4", "4", "h4"))
    run()
    folder = str(tmp_path / "out_state")
    held = state.BucketState(spark, folder, "url", 16)
    one = {r.u: r.b for r in spark.createDataFrame([("u3",), ("u4",), ("fresh",)], "u string").select("u", state.bucket_of(F.col("u"), 16).alias("b")).collect()}
    written = {n: len(glob.glob(f"{folder}/batch={n}/bucket=*")) for n in (0, 1, 2)}
    assert written[1] <= 3 and written[2] == 1 and len(held.versions()) == 16
    assert 0 not in held.versions()[one["u4"]] and held.versions()[one["u4"]][-1] == 2  # what was read over has gone
    got = {(r.url, r.erisim_zamani) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(f"u{i}", "1") for i in range(200)} | {("u4", "2"), ("fresh", "2"), ("u4", "4")}
    now = {r.url: r.icerik_hash for r in held.rows("url string, erisim_zamani string, icerik_hash string").collect()}
    assert len(now) == 201 and now["u4"] == "h4" and now["u3"] == "h3"


def test_an_index_takes_changes(spark, tmp_path):
    path = str(tmp_path / "index")
    text = lambda w: f"{w} uzun bir satır " * 8
    docs = lambda *rows: spark.createDataFrame(list(rows), "id long, text string")
    none = spark.createDataFrame([], "id long")
    told = sinks.update_index(spark, 0, path, docs(*[(i, text(f"k{i}")) for i in range(60)], (99, None)), none, "id", "text", buckets=8)
    assert (told["came"], told["stay"], told["buckets"]) == (60, 60, 8)
    for _ in range(2):  # run again
        told = sinks.update_index(spark, 1, path, docs((1, text("changed"))), docs((2, ""), (500, "")).select("id"), "id", "text", buckets=8)
        assert (told["came"], told["went"], told["stay"]) == (1, 1, 59) and told["buckets"] <= 3
    held = {r.id: r.chunk for r in state.BucketState(spark, path, "id", 8).rows("id long, place int, chunk string, terms array<string>").collect()}
    assert "changed" in held[1] and 2 not in held and "k3" in held[3]
    assert sinks.update_index(spark, 2, path, docs().limit(0), none, "id", "text", buckets=8)["buckets"] == 0
    # a bucket whose documents all go stays empty
    told = sinks.update_index(spark, 3, path, docs((1000, None)), spark.range(0, 60), "id", "text", buckets=8)
    assert told["stay"] == 0 and told["chunks"] == 0
