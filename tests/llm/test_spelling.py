"""Spelling variants against plain loops, and odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from tessera.llm import spelling as S

SCHEMA = "doc_id long, text string"


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, close in near.items():
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed=3):
    """Frequent words, variants of variants, many words around one, repeated letters and ties."""
    rng, rows = random.Random(seed), []
    letters = "abcaaéÿÉ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(12)] + ["aaaaaaaa", "Aaaaaaaaa", "bananana"]
    for base in bases:
        rows += [base] * rng.choice([2, 3, 40, 400])
        for _ in range(40):
            i, kind = rng.randrange(len(base)), rng.randrange(3)
            w = base[:i] + (rng.choice(letters) if kind else "") + base[i + (kind < 2) :]
            rows += [w] * rng.choice([1, 2, 2, 4])
            i = rng.randrange(len(w))
            rows += [w[:i] + rng.choice(letters) + w[i:]] * 2
    rng.shuffle(rows)
    docs = [(i // 7, " ".join(rows[i : i + 7]) + rng.choice([".", "3short", "ı"])) for i in range(0, len(rows), 7)]
    return [*docs, (None, "nullidword nullidword nullidwore"), (None, "nullidword"), (1, None), (2, ""), (3, docs[0][1]), (3, docs[0][1])]


def test_variants_equal_plain_loops(spark):
    rows = corpus()
    want = plain(rows)
    assert any(f and r != f for _, f, r, *_ in want) and max(x[4] for x in want) > 20
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", id int, word string, n double")
    got = [tuple(r) for r in S.variants(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_word_among_very_many_near_ones(spark):
    hub = "abcdefgh"
    words = {hub[:i] + x + hub[i + k :] for i in range(8) for x in "abcdefghijklmnopqrstuvwxyzàáâãä" for k in (0, 1)}
    rows = [(i, f"{w} {w}") for i, w in enumerate(sorted(words))] + [(-i, f"{hub} " * 50) for i in range(1, 9)]
    assert {tuple(r) for r in S.variants(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows)


def test_empty_short_and_very_long(spark):
    assert S.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert S.variants(spark.createDataFrame([(1, "no long ones here"), (2, None)], SCHEMA)).collect() == []
    long = "ab" * 200_000
    rows = [(1, f"{long} {long}"), (2, f"{long[:-1]}z {long[:-1]}z"), (3, long), (4, "a" * 300_000 + " " + "a" * 300_000)]
    got = {(len(r.word), r.n, r.n_near) for r in S.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(len(w), n, sum(len(w) == len(v) == 400_000 and w != v for v in plain_words(rows))) for w, n in plain_words(rows).items()}


def test_keys_are_those_of_the_rests():
    words = ["a", "ab", "banana", "béébé", "x" * 5]
    keys = S._keys(words)
    for i, w in enumerate(words):
        rests = [w[:j] + w[j + 1 :] for j in range(len(w))]
        for j, rest in enumerate(rests):
            own = [0] * 4 if not rest else [sum(ord(c) * pow(b, e, p) for e, c in enumerate(rest)) % p for p, b in zip(S.PRIMES, S.BASES, strict=True)]
            assert (keys.rest1[i][j], keys.rest2[i][j]) == (own[0] << 31 | own[1], own[2] << 31 | own[3])
        assert [r for r, f in zip(rests, keys["first"][i], strict=True) if f] == list(dict.fromkeys(rests))


def test_batches_hold_whole_words(monkeypatch):
    monkeypatch.setattr(S, "LETTERS_AT_ONCE", 10)
    frame = pd.DataFrame({"id": range(5), "word": ["abcdefg", "a" * 30, "abc", "abcd", "ab"], "n": 1})
    parts = list(S._emit(iter([frame])))
    assert [len(p) for p in parts] == [1, 1, 3] and pd.concat(parts)["rest1"].str.len().tolist() == [7, 30, 3, 4, 2]


def test_a_clash_of_keys_is_noticed(spark, monkeypatch):
    words = spark.createDataFrame([(0, "abcdefgh", 2), (1, "zyxwvuts", 3)], "id long, word string, n long")
    same = S.emitted(words).selectExpr("id", "n", "id AS own1", "id AS own2", "array(5L) AS rest1", "array(5L) AS rest2", "array(true) AS first")
    monkeypatch.setattr(S, "emitted", lambda w: same)
    with pytest.raises(PySparkException, match="one key"):
        S.near(words).collect()
