"""Positions and previous rows over bins equal those of one sorted list, with nulls, ties, hot groups and an empty table."""

from __future__ import annotations

import random

import pytest
from tessera.operators import history, ordered
from tessera.operators.ordered import By
from tessera.operators.ranking import rank_nulls_last

SCHEMA = "g string, v double, k int, content string"


def made(n=600):
    draw = random.Random(5)
    rows = [("hot" if i % 3 else draw.choice(["a", "b", None]), draw.choice([None, 1.0, 2.0, 2.0, draw.random()]), i, draw.choice(["x", "y", None])) for i in range(n)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("descending", [False, True])
def test_positions_equal_a_sorted_list(spark, descending):
    rows = made()
    got = {r.k: r.position for r in rank_nulls_last(spark.createDataFrame(rows, SCHEMA), "v", ["k"], descending, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, 0 if r[1] is None else (-r[1] if descending else r[1]), r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))


def test_changes_are_seen_across_bins(spark):
    rows = made()
    got = {r.k for r in history.changes(spark.createDataFrame(rows, SCHEMA), ["g"], ["k"], "content").collect()}
    want = set()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[2])
        want |= {r[2] for i, r in enumerate(mine) if not i or r[3] != mine[i - 1][3]}
    assert got == want


def test_equal_rows_empty_tables_and_no_group(spark):
    same = spark.createDataFrame([("a", 1.0, 1, "x")] * 5, SCHEMA)
    assert sorted(r.position for r in rank_nulls_last(same, "v", ["k"]).collect()) == [1, 2, 3, 4, 5]
    assert history.changes(same, ["g"], ["k"], "content").count() == 1
    none = same.limit(0)
    assert rank_nulls_last(none, "v", ["k"], within=["g"]).count() == 0 and history.changes(none, ["g"], ["k"], "content").count() == 0


def test_bins_share_a_hot_group(spark):
    binned = ordered.with_bins(spark.createDataFrame(made(2000), SCHEMA), [By("v", nulls_last=True), By("k")], "bin")
    sizes = [r["count"] for r in binned.groupBy("bin").count().collect()]
    assert len(sizes) > ordered.BINS / 2 and max(sizes) < 2000 / 10
