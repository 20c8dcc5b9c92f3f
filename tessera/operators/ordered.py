"""Order inside groups of any size: rows are dealt into bins of the whole order, so that many tasks share a hot group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of an order, and rows drawn to choose their edges (all the driver gets). No result depends on them.
BINS, DRAWN = 64, 4096


@dataclass(frozen=True)
class By:
    """A column of an order. Nulls come first unless they are last by nulls_last or by a descending order."""

    name: str
    descending: bool = False
    nulls_last: bool = False

    def sort(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def before(self, edge: object) -> Column:
        """Whether the column's value stands before the edge's."""
        c, last = F.col(self.name), self.descending or self.nulls_last
        if edge is None:
            return c.isNotNull() if last else F.lit(False)
        return F.coalesce(c > F.lit(edge) if self.descending else c < F.lit(edge), F.lit(not last))


def _before(order: list[By], edge: tuple) -> Column:
    out = F.lit(False)
    for by, value in reversed(list(zip(order, edge, strict=True))):
        out = by.before(value) | (F.col(by.name).eqNullSafe(F.lit(value)) & out)
    return out


def _place(order: list[By], edges: list[tuple], first: int = 0) -> Column:
    """The number of edges that don't stand behind the row, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(_before(order, edges[mid]), _place(order, edges[:mid], first)).otherwise(_place(order, edges[mid + 1 :], first + mid + 1))


def with_bins(df: DataFrame, order: list[By], name: str) -> DataFrame:
    """Add name: a bin that grows with the order. Edges are drawn once and stay in the plan, so a task that runs again bins alike."""
    names = [by.name for by in order]
    drawn = df.select(*names).orderBy(F.rand(7)).limit(DRAWN).orderBy(*[by.sort() for by in order]).collect()
    step = max(1, len(drawn) // BINS)
    return df.withColumn(name, _place(order, list(dict.fromkeys(tuple(r) for r in drawn[step::step]))))


def beside_bin(df: DataFrame, within: list[str], name: str, facts: DataFrame) -> DataFrame:
    """Join facts of (within, bin), at most BINS rows of a group, to the rows of df; groups may be null."""
    slim = facts.select(*[F.col(c).alias(f"_of_{c}") for c in [*within, name]], *[c for c in facts.columns if c not in (*within, name)])
    on = F.col(name) == F.col(f"_of_{name}")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(slim, on).drop(*[f"_of_{c}" for c in [*within, name]])


def with_position(df: DataFrame, within: list[str], order: list[By], name: str = "position", total: str | None = None) -> DataFrame:
    """Add name: 1..n inside each group, and total: n. A row's place in its bin comes after the counts of the group's earlier bins."""
    rows = with_bins(df, order, "_bin")
    counts = rows.groupBy(*within, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within)
    earlier = F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select(*within, "_bin", earlier.alias("_earlier"), *([F.sum("_n").over(group).alias(total)] if total else []))
    place = F.row_number().over(Window.partitionBy(*within, "_bin").orderBy(*[by.sort() for by in order]))
    return beside_bin(rows.withColumn(name, place), within, "_bin", counts).withColumn(name, (F.col(name) + F.col("_earlier")).cast("int")).drop("_bin", "_earlier")


def with_previous(df: DataFrame, within: list[str], order: list[By], content: str, name: str) -> DataFrame:
    """Add name: struct of the content of the group's row before, null for its first row; a bin's first row takes the last of the bin before."""
    rows = with_bins(df, order, "_bin")
    held = F.struct(F.col(content).alias("content"))
    last = rows.groupBy(*within, "_bin").agg(F.max_by(held, F.struct(*[by.name for by in order])).alias("_last"))
    carried = last.select(*within, "_bin", F.lag("_last").over(Window.partitionBy(*within).orderBy("_bin")).alias("_carried"))
    inside = F.lag(held).over(Window.partitionBy(*within, "_bin").orderBy(*[by.sort() for by in order]))
    return beside_bin(rows.withColumn(name, inside), within, "_bin", carried).withColumn(name, F.coalesce(name, "_carried")).drop("_bin", "_carried")
