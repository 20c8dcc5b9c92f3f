"""Lattice hashing: what it leaves on disk, cells that batches cut, vectors of several lengths."""

import os
import threading

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lattice
from tessera.operators.durable import shared_dir


def files(folders: list[str]) -> dict[str, int]:
    out = {}
    for folder in folders:
        for path, _, names in os.walk(folder):
            for name in names:
                try:
                    out[f"{path}/{name}"] = os.path.getsize(f"{path}/{name}")
                except OSError:  # it went meanwhile
                    pass
    return out


def test_disk_holds_one_round_of_cells(spark, monkeypatch, tmp_path):
    n = 3000
    monkeypatch.setattr(lattice, "ENTRIES", n * (lattice.PROBES + 1))
    vectors = np.random.default_rng(1).normal(size=(n, 32))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    shared_dir(spark)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [*[str(x) for x in local], spark.sparkContext.getCheckpointDir().removeprefix("file:")]
    old, most, ended = set(files(folders)), [0], threading.Event()

    def watch():
        while not ended.wait(0.05):
            most[0] = max(most[0], sum(size for name, size in files(folders).items() if name not in old))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert lattice.near_copies(frame, scale=1.6).where("n_links = 0").count() == n
    finally:
        ended.set()
        watcher.join()
    whole = n * lattice.tables_at(1.6) * (lattice.PROBES + 1)
    assert most[0] < 4 * whole, most  # a quarter of what keys and nodes of all tables' cells take


@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_cells_are_whole_however_batches_cut_them(cut):
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(60, 24))
    unit[20:] = unit[3] + 0.1 * rng.normal(size=(40, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    node, key, own = rng.permutation(60) * 7 - 100, np.sort(rng.integers(0, 9, 60)), rng.integers(0, 2, 60)
    low, high = lattice._sketches(unit).T
    columns = [key, node, (2 * 5 + own).astype(np.int32), low, high]
    whole = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "node", "what", "low", "high"])
    pairs, hot = [], []
    for batch in lattice._cell_pairs(0.95, 6)(whole.slice(i, cut) for i in range(0, 60, cut)):
        for row in batch.to_pylist():
            (pairs if row["is_pair"] else hot).append(row)
    size = np.bincount(key, minlength=9)
    assert sorted((r["key"], r["a"], r["place"]) for r in hot) == sorted((key[i], node[i], 10 + own[i]) for i in range(60) if size[key[i]] > 6)
    may, must = {}, set()
    for i in range(60):
        for j in range(60):
            if key[i] == key[j] and size[key[i]] <= 6 and node[i] < node[j] and own[i] + own[j]:
                may[node[i], node[j]] = 20 + (0 if own[i] and own[j] else 1 if own[i] else 2)
                must |= {(node[i], node[j])} if unit[i] @ unit[j] >= 0.95 else set()
    told = {(r["a"], r["b"]): r["place"] for r in pairs}
    assert len(told) == len(pairs) and must <= set(told) <= set(may) and must
    assert all(place == may[pair] for pair, place in told.items())


@pytest.mark.parametrize("length", [1, 5, 16, 64, 300])
def test_sketches_part_no_near_vectors(length):
    rng = np.random.default_rng(length)
    a, b = rng.normal(size=(2, 2000, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + rng.uniform(0, 0.35, size=(2000, 1)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    near = (lattice._units(a) * lattice._units(b)).sum(1) >= 0.95
    differ = lattice._sketches(lattice._units(a)).view(np.int8).astype(float) - lattice._sketches(lattice._units(b)).view(np.int8)
    assert near.any() and (differ[near] ** 2).sum(1).max() <= lattice._sketch_bound(0.95)


@pytest.mark.parametrize("large", [64, 1])
def test_vectors_of_several_lengths(spark, monkeypatch, large):
    monkeypatch.setattr(lattice, "LARGE", large)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [2.0, 0.0, 0.0])]
    told = {tuple(r) for r in lattice.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert told == {(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False)}
