"""Repair of conversations against a search over all edits, in both ways, and odd input."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from tessera.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def repaired(rows):
    """The plain way: every edit of every row, up to two inserts before each and at the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    best = [None]

    def search(i, cost, audit, out):
        """Every edit and up to two inserts before each row and at the end, unless the roles so far fit no pattern."""
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in out)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            best[0] = min(best[0] or (cost, audit, out), (cost, audit, out))
        if not audit.endswith("II"):
            for r in ("user", "assistant"):
                search(i, cost + 2, audit + "I", [*out, (r, "")])
        if i < len(rows):
            _, role, text = rows[i]
            search(i + 1, cost + 3, audit + "D", out)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                search(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    search(i + 1, cost + 2 + more, audit + "R", [*out, (r, text)])

    search(0, 0, "", [])
    best = best[0]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, best[0], best[1], hashlib.sha256(text.encode()).hexdigest())


def small(n, longest, seed=5):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rng.choice([t, t, t, None, 7 * t]), role, rng.choice(["a.", "b!", "a.", "c?", "long one", " \t", "", None, "é", "x\ny."])))
    return rows


def as_dict(df):
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


ODD = [(None, 1, "user", "null id."), (None, 1, "user", "null id."), (None, None, None, None), (None, None, "assistant", "yes.")]


@pytest.mark.parametrize("long", [4096, 1])
def test_cheapest_edits(spark, long, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 2)
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [*small(60, 4), *ODD, (dropped, 0, "user", "gone.")]
    want = {k: repaired(v) for k, v in damaged(rows).items()}
    assert len(want) == 62 and want[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", place int, turns string")
    assert as_dict(C.repair(df, long)) == want


def test_both_ways_and_sql_agree_on_longer_ones(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 7)
    rows = small(25, 60, 9) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    short, by_segments = as_dict(C.repair(df)), as_dict(C.repair(df, 10))
    assert short == by_segments
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = con.execute(C.oracle_sql())
    names = [d[0] for d in result.description]
    assert names == C.repair(df).columns
    assert {r[0]: tuple(r[1:]) for r in result.fetchall()} == short


def test_hot_conversation_among_others(spark):
    rng = random.Random(2)
    hot = [(5, i, rng.choice(["user", "assistant"]), rng.choice([f"t{i}.", "again.", f"t{i}"])) for i in range(3000)]
    df = spark.createDataFrame(hot + small(40, 4), SCHEMA)
    assert as_dict(C.repair(df)) == as_dict(C.repair(df, 1000))


def test_empty_and_very_long(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(2, 0, "user", "a" * 3_000_000), (2, 1, "assistant", " " * 2_000_000 + "."), (2, 2, "system", "\t" * 1_000_000)]
    want = {k: repaired(v) for k, v in damaged(rows).items()}
    assert as_dict(C.repair(spark.createDataFrame(rows, SCHEMA))) == want
    wide = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], SCHEMA)
    assert as_dict(C.repair(wide))[1][0] in (None, 0)
