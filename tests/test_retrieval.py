"""Pruned sparse and dense search against the plain product, and the work that they save."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import nearest, retrieval

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


def skewed(rng, n):
    return [WORDS[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(n)]


def plain_top(docs, asked, k):
    tf = {d: Counter(t) for d, t in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    out = set()
    for q, text in asked.items():
        score = defaultdict(float)
        for w, n in Counter(text).items():
            for d, c in tf.items():
                if w in c:
                    score[d] += n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w]
        best = sorted(((-round(s, 6), d) for d, s in score.items()))[:k]
        out |= {(q, d, i + 1) for i, (_, d) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard", [100_000, 40])
def test_sparse_search_is_exact_and_opens_few_blocks(spark, monkeypatch, shard):
    monkeypatch.setattr(retrieval, "SHARD", shard)
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    rng = random.Random(5)
    docs = {i: skewed(rng, rng.choice([5, 20, 60, 600 if i % 40 == 0 else 30])) for i in range(600)}
    asked = {i: skewed(rng, rng.choice([1, 3, 8])) for i in range(25)} | {98: ["unknown"], 99: []}
    frame = lambda x, key: spark.createDataFrame([(i, " ".join(t), 0) for i, t in x.items()] + [(None, None, 0)], f"{key} long, text string, tf int").where(f"{key} IS NOT NULL")
    held, queries = retrieval.postings(frame(docs, "d"), "d", "text"), retrieval.postings(frame(asked, "q"), "q", "text")
    n = spark.createDataFrame([(len(docs),)], "n long")
    got = retrieval.sparse_search(queries, held, "q", "d", n, 5)
    assert {(r.q, r.d, r.position) for r in got.collect()} == plain_top(docs, asked, 5)
    blocks = retrieval.posting_blocks(held.join(queries.select("term").distinct(), "term", "left_semi"), "d", 8).cache()
    opened = retrieval.pruned_pairs(queries, blocks, "q", "d", n, 5).agg(F.sum("n")).first()[0]
    every = queries.join(held, "term").count()
    assert opened < 0.7 * every, (opened, every)


def test_postings_sum_words_and_stems(spark):
    df = spark.createDataFrame([(1, "kampanyalar kampanyası ve Kısa kısa"), (2, None), (3, "")], "d long, text string")
    got = {(r.d, r.term): r.tf for r in retrieval.postings(df, "d", "text").collect()}
    assert got == {(1, "kampanyalar"): 1.0, (1, "kampanyası"): 1.0, (1, "~kampa"): 0.8, (1, "kısa"): 2.0}


def test_dense_search_is_exact_and_compares_few(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    vectors = {i: centres[i % 40] + 0.15 * rng.normal(size=24) for i in range(2000)}
    vectors |= {3000 + i: vectors[7] for i in range(6)}  # ties
    odd = [(5000, None), (5001, [0.0] * 24), (5002, []), (5003, [float("nan")] * 24), (5004, [1.0, 2.0]), (5005, [1.0, None]), (5006, [2.0, 1.0]), (None, [1.0] * 24)]
    rows = [(i, v.tolist()) for i, v in vectors.items()] + odd
    held = spark.createDataFrame([(*r, 1) for r in rows], "d long, embedding array<double>, size int")
    asked = held.where("d % 97 = 0 OR d >= 3003 OR d IS NULL").select(F.col("d").alias("q"), "embedding")
    got = {(r.q, r.position): (r.d, round(r.score, 6)) for r in retrieval.dense_search(asked, held, "q", "d", 4).collect()}
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    want = {}
    for q in [i for i in vectors if i % 97 == 0 or i >= 3003]:
        cosine = np.round(matrix @ matrix[np.searchsorted(ids, q)], 9)
        want |= {(q, p + 1): (ids[j], round(float(cosine[j]), 6)) for p, j in enumerate(np.lexsort((ids, -cosine))[:4])}
    assert {x: y for x, y in got.items() if x[0] < 5000} == want
    assert {x: y[0] for x, y in got.items() if x[0] >= 5000} == {(5004, 1): 5004, (5004, 2): 5006, (5006, 1): 5006, (5006, 2): 5004}
    made = nearest.compared(asked.where("q < 5000"), held.where("d < 5000"), "q", "d", 4).where("q IS NULL").agg(F.sum("score")).first()[0]
    assert made < 0.25 * asked.where("q < 5000").count() * len(ids), made
    assert retrieval.dense_search(asked.limit(0), held, "q", "d", 4).collect() == [] == retrieval.dense_search(asked, held.limit(0), "q", "d", 4).collect()
    assert retrieval.dense_search(asked, held, "q", "d", 1, payload=F.col("d") == 5006).select("d").distinct().collect()[0].d == 5006


def test_queries_beyond_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BYTES", 400)
    rng = np.random.default_rng(1)
    held = spark.createDataFrame([(f"k{i:03}", rng.normal(size=5).tolist()) for i in range(200)], "d string, embedding array<double>")
    asked = held.limit(30).withColumnRenamed("d", "q")
    got = retrieval.dense_search(asked, held, "q", "d", 3)
    assert got.count() == 90 and got.where("position = 1 AND q != d").count() == 0


def test_postings_travel_only_where_a_key_repeats(spark):
    texts = [("a", "uzun kampanya kampanyalar"), ("b", "uzun yol"), ("b", "kampanyası yol"), ("c", None), (None, "yol")]
    frame = lambda rows: spark.createDataFrame(rows, "d string, text string")
    once = retrieval.postings(frame(texts[:2] + texts[3:]), "d", "text")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    got = {(r.d, r.term): r.tf for r in retrieval.postings(frame(texts), "d", "text").collect()}
    assert got == {
        ("a", "uzun"): 1.0, ("a", "kampanya"): 1.0, ("a", "kampanyalar"): 1.0, ("a", "~kampa"): 0.8, ("b", "uzun"): 1.0, ("b", "yol"): 2.0, ("b", "kampanyası"): 1.0,
        ("b", "~kampa"): 0.4, (None, "yol"): 1.0,
    }


def test_few_and_many_queries_find_the_same(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(f"d{i:04d}", " ".join(skewed(rng, rng.choice([1, 4, 30])) if i % 3 else [WORDS[0], WORDS[i % 5]])) for i in range(400)]  # many equal scores
    held = retrieval.postings(spark.createDataFrame(docs, "d string, text string"), "d", "text").cache()
    queries = retrieval.postings(spark.createDataFrame([(i, " ".join(skewed(rng, 4))) for i in range(12)], "q long, text string"), "q", "text").cache()
    n, found = spark.createDataFrame([(len(docs),)], "n long"), []
    for asked, matrix in ((retrieval.ASKED, retrieval.MATRIX), (retrieval.ASKED, 60), (0, 1)):
        monkeypatch.setattr(retrieval, "ASKED", asked)
        monkeypatch.setattr(retrieval, "MATRIX", matrix)
        found.append({(r.q, r.d, round(r.score, 6), r.position) for r in retrieval.sparse_search(queries, held, "q", "d", n, 5).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 12
