"""The fuzzy join against all pairs, and how few it makes."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from tessera.operators import fuzzy


def corpus(rng, n):
    out = set()
    letters = "abcdefghijklmnopqrstuvwxyzçğış"
    while len(out) < n:
        base = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 4, 7, 9, 12, 20, 33])))
        out.add(base)
        for _ in range(3):
            i, j = sorted((rng.randrange(len(base) + 1), rng.randrange(len(base) + 1)))
            out.add(rng.choice([base[:i] + rng.choice(letters) + base[i:], base[:i] + base[j:], base[j:] + base[:j], base + base[:i]]))
    return sorted(out - {""})


@pytest.mark.parametrize("least", [0.75, 0.9, 0.6])
def test_all_pairs_are_found_and_few_are_made(spark, least):
    rng = random.Random(int(100 * least))
    forms = corpus(rng, 220)
    phrases = rng.sample(forms, 60) + corpus(rng, 60) + ["", "aaaaaaaa", "aaaaaaaaaaaaaaaaaaaa"]
    frame = lambda x, name: spark.createDataFrame([(v,) for v in [*x, None, x[0]]], f"{name} string")
    got = {(r.p, r.f): r.score for r in fuzzy.alike(frame(phrases, "p"), frame([*forms, ""], "f"), "p", "f", least).collect()}
    want = {}
    for p in set(phrases):
        for f in forms:
            if p and (score := SequenceMatcher(None, p, f).ratio()) >= least:
                want[p, f] = score
    assert got == want and len(want) > 60
    made = fuzzy.candidates(frame(phrases, "p"), frame(forms, "f"), "p", "f", least).count()
    assert made < (0.5 if least > 0.7 else 0.8) * len(set(phrases)) * len(forms), made


def test_odd_input(spark):
    empty = spark.createDataFrame([], "p string")
    some = spark.createDataFrame([("x",)], "f string")
    assert fuzzy.alike(empty, some, "p", "f", 0.75).collect() == []
    with pytest.raises(ValueError, match="least"):
        fuzzy.alike(empty, some, "p", "f", 0)
