"""Exact nearest neighbours by cosine: vectors in blocks around pivots, of which only those are opened that a bound allows.

A bounded sample of vectors serves as pivots; a vector goes to the block of its nearest, with the angle between them. By the triangle
inequality a query at angle a from a pivot is at least max(0, a - high, low - a) away from all vectors of a block whose angles lie
between low and high. Every query is compared with blocks of its own pivot first, whose k-th score is a bound that its k best
reach; after that with those blocks only whose nearest possible vector reaches it, and in a task the bound rises from block to block.
Comparisons of a block are one matrix product. Which vectors are pivots changes the work, never the result.

Null, empty and zero vectors, and those with null or non-finite numbers, meet nothing; vectors meet those of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

#: Pivots, vectors of a block at most, and bytes of queries that are broadcast at once.
PIVOTS, BLOCK, QUERY_BYTES = 64, 1024, 32 << 20
#: More than rounding can change a cosine.
MARGIN = 1e-7


def unit(vector: Column) -> Column:
    """The vector as doubles of length 1, null where it has none."""
    c = vector.cast("array<double>")
    square = F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    sure = (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & (square > 0) & (square < float("inf"))
    return F.when(F.coalesce(sure, F.lit(False)), F.transform(c, lambda x: x / F.sqrt(square)))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Pivots:
    """Unit vectors by their length, at most PIVOTS altogether."""

    def __init__(self, vectors: list[list[float]]) -> None:
        self.by_size = {n: np.array([v for v in vectors if len(v) == n]) for n in {len(v) for v in vectors}}

    def nearest(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's pivot (-1 without one) and the angle to it."""
        own = self.by_size.get(matrix.shape[1])
        if own is None:
            return np.full(len(matrix), -1), np.zeros(len(matrix))
        cosine = matrix @ own.T
        best = cosine.argmax(axis=1)
        return best, _angle(cosine[np.arange(len(matrix)), best])

    def angles(self, matrix: np.ndarray, pivot: int) -> np.ndarray | None:
        """The angle of each row to one pivot; None where there is none."""
        return _angle(matrix @ self.by_size[matrix.shape[1]][pivot]) if pivot >= 0 else None


def _located(pivots: Pivots, doc: str):
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(batch["v"].str.len()):
                pivot, angle = pivots.nearest(np.stack(rows["v"].to_numpy()))
                yield pd.DataFrame({doc: rows[doc].to_numpy(), "size": rows["v"].str.len().to_numpy(), "pivot": pivot, "angle": angle, "v": rows["v"].to_numpy()})

    return locate


def blocks(vectors: DataFrame, doc: str, vector: str, pivots: Pivots) -> DataFrame:
    """size, pivot, low, high, held (structs of doc and unit vector): up to BLOCK vectors at like angles from one pivot.

    Vectors of a pivot are dealt to shards by their hash, as many as the table needs so that none gathers over about 64 blocks.
    """
    units = vectors.select(F.col(doc), unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    kind = vectors.schema[doc].dataType.simpleString()
    placed = cut(units.mapInPandas(_located(pivots, doc), f"`{doc}` {kind}, size int, pivot int, angle double, v array<double>"))
    shards = placed.count() // (64 * BLOCK) + 1
    key = ["size", "pivot", "_shard"]
    rows = placed.withColumn("_shard", F.pmod(F.xxhash64(doc), F.lit(shards)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("angle", doc)) - 1
    groups = rows.withColumn("_block", F.floor(place / BLOCK)).groupBy(*key, "_block")
    held = groups.agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.collect_list(F.struct(F.col(doc).alias("doc"), "v")).alias("held"))
    return held.select("size", "pivot", "low", "high", "held")


class Queries:
    """A bounded set of queries: their ids, unit vectors, pivots and angles, and the bounds that their k best reach."""

    def __init__(self, rows: list, pivots: Pivots, k: int) -> None:
        self.pivots, self.k, self.groups = pivots, k, {}
        for n in {len(r["v"]) for r in rows}:
            own = [r for r in rows if len(r["v"]) == n]
            matrix = np.array([r["v"] for r in own])
            self.groups[n] = (np.array([r["id"] for r in own], dtype=object), matrix, pivots.nearest(matrix)[0])
        self.bound: dict[int, np.ndarray] = {n: np.full(len(g[0]), -2.0) for n, g in self.groups.items()}

    def scored(self, only_own: bool, query: str, doc: str):
        """A function over blocks: query, doc, score of the k best of a task for each query, and (in a row without doc) how many cosines it made."""

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bound = {n: b.copy() for n, b in self.bound.items()}
            best: dict[tuple[int, int], list[tuple[float, object]]] = {}
            made = 0
            for batch in batches:
                for size, pivot, low, high, held in batch.itertuples(index=False):
                    if size not in self.groups:
                        continue
                    _, matrix, mine = self.groups[size]
                    if only_own:
                        asked = np.flatnonzero(mine == pivot)
                    else:
                        angle = self.pivots.angles(matrix, pivot)
                        near = np.zeros(len(matrix)) if angle is None else np.maximum(np.maximum(0.0, angle - high), low - angle)
                        asked = np.flatnonzero(np.cos(near) + MARGIN >= bound[size])
                    if not len(asked):
                        continue
                    made += len(asked) * len(held)
                    docs = [h["doc"] for h in held]
                    cosines = np.round(matrix[asked] @ np.stack([h["v"] for h in held]).T, 9)
                    for row, q in zip(cosines, asked, strict=True):
                        old = best.get((size, q), [])
                        # equal scores go to the smaller id, so all that reach the k-th are looked at
                        found = [(-row[j], docs[j]) for j in np.flatnonzero(row >= max(bound[size][q] - MARGIN, np.partition(row, -self.k)[-self.k] if len(row) > self.k else -2.0))]
                        best[size, q] = sorted(old + found)[: self.k]
                        if len(best[size, q]) == self.k:
                            bound[size][q] = max(bound[size][q], -best[size, q][-1][0])
            rows = [(self.groups[n][0][q], d, -s) for (n, q), found in best.items() for s, d in found]
            yield pd.DataFrame({query: [r[0] for r in rows] + [None], doc: [r[1] for r in rows] + [None], "score": [r[2] for r in rows] + [float(made)]}, dtype=object).astype({"score": float})

        return score


def compared(queries: DataFrame, vectors: DataFrame, query: str, doc: str, k: int, vector: str = "embedding") -> DataFrame:
    """query, doc, score: the k best of each task for every query, among them those of all; rows without query hold how many cosines a task made."""
    sampled = vectors.select(unit(F.col(vector)).alias("v"), F.xxhash64(doc).alias("_h")).where("v IS NOT NULL")
    pivots = Pivots([r["v"] for r in sampled.orderBy("_h").limit(PIVOTS).collect()])
    held = cut(blocks(vectors, doc, vector, pivots))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query), (vectors, doc))]
    shape = f"`{query}` {kinds[0]}, `{doc}` {kinds[1]}, score double"
    asked = cut(queries.select(F.col(query).alias("id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL"))
    total = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    parts = total * 8 // QUERY_BYTES + 1
    out = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # a bounded share of the stated queries
        if not rows:
            continue
        own = Queries(rows, pivots, k)
        first = held.mapInPandas(own.scored(True, query, doc), shape).where(F.col(query).isNotNull())
        reached = first.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))).where(F.col("_n") == k)
        bounds = {r[query]: r["score"] for r in reached.collect()}  # one number for each of those queries
        for n, (ids, _, _) in own.groups.items():
            own.bound[n] = np.array([bounds.get(i, -2.0) for i in ids])
        out.append(held.mapInPandas(own.scored(False, query, doc), shape))
    none = vectors.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, out, none)


def search(queries: DataFrame, vectors: DataFrame, query: str, doc: str, k: int, vector: str = "embedding") -> DataFrame:
    """query, doc, score: candidates that hold the k nearest by cosine of each query; rows with null ids are left out."""
    found = compared(queries.where(F.col(query).isNotNull()), vectors.where(F.col(doc).isNotNull()), query, doc, k, vector)
    return found.where(F.col(query).isNotNull())
