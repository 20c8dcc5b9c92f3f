"""Connected components by alternating large-star and small-star, in DataFrame functions.

Every step is one aggregation (the least neighbour of a node, summed before the shuffle) and one join;
edges are written to the shared folder after each round, and the rounds end when no edge changes. Nodes with
over 1 / ``HOT`` of all edges (fewer than 2 * HOT) are joined by broadcast, so no task gathers a hub's edges.

Defined results: links with a null end and links of a node to itself are ignored; repeated links count once; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Up to so many edges, least neighbours (no more rows than twice that) are broadcast instead of shuffled.
BROADCAST_EDGES = 500_000
EDGES_PER_TASK = 50_000


#: Share of all edges that makes a node a hub.
HOT = 4096


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows joined to u's least neighbour m; least has u, m and n, the number of edges at u."""
    if edges <= BROADCAST_EDGES:
        return rows.join(F.broadcast(least.drop("n")), "u")
    hub = F.col("n") > edges // HOT
    near = rows.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    far = near.where("hub_m IS NULL").drop("hub_m").join(least.where(~hub).drop("n"), "u")
    return far.unionByName(near.where("hub_m IS NOT NULL").withColumnRenamed("hub_m", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or to the node itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    tied = _with_least(both.where("v > u"), least, n)
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(down, least, n)
    ties = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return joined.select(ties.alias("t")).select("t.u", "t.v").where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of numbers: node, component (the least node reachable); nodes without links don't appear."""
    edges = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        dealt = edges.coalesce(mark[0] // EDGES_PER_TASK + 1)
        edges = cut(_small_star(cut(_large_star(dealt, mark[0])).coalesce(mark[0] // EDGES_PER_TASK + 1), mark[0]))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    edges = edges.coalesce(mark[0] // EDGES_PER_TASK + 1)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
