"""The corpus pipeline stage by stage against plain versions, on a small table with odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from tessera.llm import mixing, packing

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(41)
    word = lambda k: "".join(rng.choice("abcdefgh" if k else "klmnopqr") for _ in range(6))
    rows = []
    for i in range(120):
        words = [word(i % 2) for _ in range(30)]
        if i % 6 == 0:
            words[7] = "nastyx"
        rows.append((i, " ".join(words) + ".", "aa" if i % 2 else "bb", "web" if i % 3 else None, 0, "clash", 1.0))
    rows += [(200 + i, rows[7][1].upper() if i % 2 else rows[7][1], "aa", "web", 0, "clash", 1.0) for i in range(5)]  # copies
    rows += [(300, None, "aa", "web", 0, None, None), (301, "", None, None, 0, None, None), (302, "12 !?", "aa", "web", 0, None, None), (None, rows[3][1], None, "web", 0, None, None)]
    rows += [(400, (rows[9][1] + " ") * 400, "aa", "web", 0, None, None), (9, rows[9][1], "aa", "web", 0, "clash", 1.0)]  # long; repeated row
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 != 0), int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_every_stage_equals_its_plain_version(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "toxicity", "minhash", "mixing", "packing"]
    rows = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns
        path = f"{folder}/after_{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
    start = spark.read.parquet(f"{folder}/documents.parquet").collect()
    lettered = [r for r in start if r.text and any(c.isalpha() for c in r.text)]
    assert Counter(map(tuple, rows["language_id"])) == Counter(map(tuple, lettered))
    assert Counter(map(tuple, rows["toxicity"])) == Counter(tuple(r) for r in lettered if "nastyx" not in r.text)
    left = {r.doc_id: r for r in rows["toxicity"] if r.doc_id is not None}
    ids = sorted(left)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            x, y = sets(left[a].text), sets(left[b].text)
            if a < b and x and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = [tuple(left[i]) for i in ids if root[i] == i] + [tuple(r) for r in rows["toxicity"] if r.doc_id is None]
    assert sorted(map(str, map(tuple, rows["minhash"]))) == sorted(map(str, kept))
    rates = {r.source: r for r in mixing.repetition_rates(spark.read.parquet(f"{folder}/after_minhash"), mixing.TARGETS).collect()}
    mixed = Counter(r.doc_id for r in rows["mixing"])
    assert set(mixed) <= {r.doc_id for r in rows["minhash"]} and set(map(tuple, rows["mixing"])) <= set(map(tuple, rows["minhash"]))
    assert all(math.isfinite(x) for r in rates.values() for x in r.cdf)
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for r in rows["mixing"]:
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, filled = Counter(), Counter()
    for p in rows["packing"]:
        got[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert got == want and max(filled.values()) <= packing.SIZE


def test_an_empty_corpus_stays_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_folds_are_those_of_crc32(spark):
    from tessera.llm.common import id_fold

    got = {r.id: r.k for r in spark.range(50).select("id", id_fold(F.col("id"), 3).alias("k")).collect()}
    assert all(k == crc32(str(i).encode()) % 3 for i, k in got.items())


def test_workers_keep_small_tables_and_get_small_batches(spark, folder):
    import pandas as pd
    from tessera.llm import minhash

    minhash._powers.cache_clear()
    assert len(minhash.shingle_set("a few words of one short text")) == 3
    assert sum(minhash._powers(x).nbytes for x in (False, True)) <= 1 << 20
    before = {key: spark.conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    sizes = lambda batches: (pd.DataFrame({"n": [len(b)], "chars": [int(b["text"].str.len().sum())]}) for b in batches)
    try:
        for name, stage in pipeline.STAGES:
            for key in before:
                spark.conf.unset(key)
            if name == "mixing":  # has no Python step
                continue
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', IF(id = 3000, 6000000, 5000)) AS text")
            got = texts.mapInPandas(sizes, "n long, chars long").collect()
            assert sum(b.n for b in got) == 4000 and sum(b.chars for b in got) == 3999 * 5000 + 6000000
            assert max(b.n for b in got) <= 1000 and all(b.chars <= 4_300_000 or b.chars - 6_000_000 <= 4_300_000 for b in got)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_powers_beyond_those_kept_are_the_same(monkeypatch):
    from tessera.llm import minhash

    text = " ".join(f"w{k}" for k in range(3000))
    minhash._powers.cache_clear()
    whole = minhash.shingle_set(text)
    monkeypatch.setattr(minhash, "KEPT", 64)
    minhash._powers.cache_clear()
    assert minhash.shingle_set(text).tolist() == whole.tolist() and len(whole) == 2996
    minhash._powers.cache_clear()
