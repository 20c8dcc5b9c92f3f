"""Embedding near-duplicates by lattice hashing.

Each of some tables (``tables_at``) projects the unit vectors by a random matrix onto eight dimensions and decodes
them to the nearest point of the E8 lattice, the vector's own cell. Besides, a vector probes the
``PROBES`` neighbouring cells that lie nearest. Two vectors are compared if they share an own cell, or if
one probes the other's; the cosine decides in double precision.

Equal vectors are merged first and counted by their number. Cells of some tables at a time are shuffled, each entry
with a sketch of its vector: its part in a subspace, which lies no further from another's than the vectors do, so
a pair whose sketches differ by more than any near pair's isn't near. Pairs of small cells that may be near by
their sketches are stored, and their vectors travel once to each star of pairs; a cell of over ``LARGE`` vectors
is dealt out in chunks, and pairs of chunks are compared as matrices. Both return numbers of links and a spanning
forest instead of pairs. A pair counts once, at the first place at which it meets: the first table in which both
have one own cell, or one probes the other's; cells are hashed again from the vectors to find it.

The projections' scale grows with the number of vectors so that a cell holds few unrelated ones. As
smaller cells part more of the near vectors too, the number of tables grows with the scale, which keeps
the share of pairs that is found: at cosine 0.95, 0.998 with ``TABLES`` tables at ``SCALE_50K``, and as much above.

Defined results: null, empty and zero vectors and those with null or non-finite components link with
nothing, as do rows with a null id; vectors of different lengths aren't compared; repeated rows count
once as partners; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import freed, stored
from .common import cut, hot_keys, join_facts
from .components import components

TABLES, PROBES = 10, 8
COSINE = 0.95
LARGE = 64
CHUNK = 1024
SCALE_50K = 1.2
LEAST_SCALE, MOST_SCALE = 0.9, 1.6
#: Entries of cells (own and probed) that are shuffled at once, as whole tables; pairs compared at once; bytes of a sketch.
ENTRIES, PAIRS, SKETCH = 8_000_000, 65_536, 16


def tables_at(scale: float) -> int:
    """Tables that find as many near pairs as ``TABLES`` do at ``SCALE_50K``."""
    return max(TABLES, int(np.ceil(TABLES * (scale / SCALE_50K) ** 4)))


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves, float)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    near = np.rint(y)
    odd = np.nonzero(near.sum(axis=1) % 2)[0]
    off = (y - near)[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: of the even-sum integers or of those moved by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@functools.cache
def _projection(table: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([table, length])
    return rng.normal(size=(length, 8)), rng.uniform(size=8)


@functools.cache
def _mixers() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 62, 10, dtype=np.int64) | 1


def _cell_keys(points: np.ndarray, table: int, length: int) -> np.ndarray:
    m = _mixers()
    with np.errstate(over="ignore"):
        h = (np.rint(2 * points).astype(np.int64) * m[:8]).sum(axis=-1) + m[8] * (table + 1) + m[9] * length
        h ^= h >> 29
        return h * m[0] ^ (h >> 32)


def _units(vectors: np.ndarray) -> np.ndarray:
    unit = vectors.astype(float)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return unit


def _cells(unit: np.ndarray, table: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each vector's own cell in a table and of the cells it probes there."""
    length = unit.shape[1]
    matrix, offset = _projection(table, length)
    y = scale * (unit @ matrix) + offset
    cell = nearest_e8(y)
    near = np.argpartition(-((y - cell) @ roots().T), PROBES, axis=1)[:, :PROBES]
    return _cell_keys(cell, table, length), _cell_keys(cell[:, None, :] + roots()[near], table, length)


@functools.cache
def _sketcher(length: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([length]).normal(size=(length, min(SKETCH, length))))
    return q * np.sign(np.diag(r))


def _sketches(unit: np.ndarray) -> np.ndarray:
    """The vectors' parts in a subspace of ``SKETCH`` dimensions, a byte each, as two numbers of eight bytes."""
    near = np.zeros((len(unit), SKETCH), np.int8)
    part = np.rint(127 * (unit @ _sketcher(unit.shape[1])))
    near[:, : part.shape[1]] = np.clip(part, -127, 127)
    return near.view(np.int64)


def _sketch_bound(limit: float) -> float:
    """The most by which sketches of vectors at cosine limit differ (squared): no more than the vectors, and half a step a side."""
    return (127 * math.sqrt(max(0.0, 2 - 2 * limit)) + math.sqrt(SKETCH)) ** 2 + 1e-3


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a column of lists without nulls by their lengths: places and matrix."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.nonzero(lengths == length)[0]
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _indexer(tables: range, scale: float):
    """Entries of cells: each vector's own cell and those it probes; what is 2 * table, and 1 more for its own."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
            for at, vectors in _by_length(batch.column("embedding")):
                unit = _units(vectors)
                node = batch.column("node").to_numpy()[at].repeat(PROBES + 1)
                low, high = _sketches(unit).repeat(PROBES + 1, axis=0).T
                for table in tables:
                    own, probed = _cells(unit, table, scale)
                    what = np.tile(np.array([2 * table + 1] + PROBES * [2 * table], np.int32), len(at))
                    columns = [np.column_stack([own, probed]).ravel(), node, what, low, high]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "node", "what", "low", "high"])

    return index


def _cell_pairs(limit: float, large: int):
    """From entries sorted by key: pairs that meet in cells of at most large entries and may be near by their sketches; larger cells as they are."""
    bound = _sketch_bound(limit)

    def out(key: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray, is_pair: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(a), pa.array(b), pa.array(place.astype(np.int32)), pa.array(np.full(len(a), is_pair))], ["key", "a", "b", "place", "is_pair"]
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None  # entries of a cell that may go on in the next batch; a large cell that began before
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "what", "low", "high")])
                rows = rows if held is None else np.concatenate([held, rows])
            if rows is None or not len(rows):
                continue
            starts = np.concatenate([[0], np.nonzero(np.diff(rows[:, 0]))[0] + 1])
            sizes = np.diff(np.append(starts, len(rows)))
            size, start = sizes.repeat(sizes), starts.repeat(sizes)
            key, node, what = rows[:, 0], rows[:, 1], rows[:, 2]
            many = size > large
            if hot is not None:
                many |= key == hot
            held = None
            if batch is not None and not many[-1]:
                held, last = rows[starts[-1] :], starts[-1]
            else:
                hot, last = key[-1], len(rows)
            if many.any():
                yield out(key[many], node[many], np.zeros(many.sum(), np.int64), what[many], False)
            owners = np.nonzero((what[:last] % 2 == 1) & (size[:last] > 1) & ~many[:last])[0]
            ends = size[owners].cumsum()
            sketch = np.ascontiguousarray(rows[:, 3:]).view(np.int8).reshape(len(rows), SKETCH)
            begin = 0
            while begin < len(owners):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                some = owners[begin:end]
                begin = end
                x = some.repeat(size[some])
                y = np.arange(len(x)) - (size[some].cumsum() - size[some]).repeat(size[some]) + start[x]
                both = what[y] % 2 == 1
                meets = (node[x] < node[y]) | ((node[x] != node[y]) & ~both)
                x, y, both = x[meets], y[meets], both[meets]
                differ = sketch[x].astype(np.float32) - sketch[y]
                near = np.einsum("ij,ij->i", differ, differ) <= bound
                x, y, both = x[near], y[near], both[near]
                swap = node[x] > node[y]
                place = 4 * (what[x] // 2) + np.where(both, 0, np.where(swap, 2, 1))
                if len(x):
                    yield out(np.zeros(len(x), np.int64), np.where(swap, node[y], node[x]), np.where(swap, node[x], node[y]), place, True)

    return meet


def _met_here(cells: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For pairs of rows (a's node below b's) whether place is the first at which they meet; cells(table, rows) are keys of cells.

    A place is 4 * table for a shared own cell, 1 more for a's cell that b probes, 2 more for b's cell that a probes.
    """
    here, table, left = np.zeros(len(a), bool), place // 4, np.arange(len(a))
    for t in range(int(table.max(initial=-1)) + 1):
        left = left[table[left] >= t]
        if not len(left):
            break
        rows, at = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
        own, probed = cells(t, rows)
        x, y = at[: len(left)], at[len(left) :]
        met = np.full(len(left), -1)
        met[(probed[x] == own[y, None]).any(axis=1)] = 4 * t + 2
        met[(probed[y] == own[x, None]).any(axis=1)] = 4 * t + 1
        met[own[x] == own[y]] = 4 * t
        here[left] = met == place[left]
        left = left[met < 0]
    return here


def _tree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) connect what all of them connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    needed = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            needed[k] = True
    return needed


KINDS = "kind string, a long, b long"


def _check_pairs(limit: float, scale: float):
    """From rows sorted by star, vectors before pairs: numbers of links, and links that connect, of the pairs that count here."""

    def found(vectors: pd.DataFrame, pairs: pd.DataFrame) -> Iterator[pd.DataFrame]:
        row = vectors[["star", "a"]].assign(row=np.arange(len(vectors)))
        i = pairs[["star", "a"]].merge(row, "left", ["star", "a"])["row"].to_numpy()
        j = pairs[["star", "b"]].rename(columns={"b": "a"}).merge(row, "left", ["star", "a"])["row"].to_numpy()
        lengths, place = vectors["embedding"].map(len).to_numpy(), pairs["place"].to_numpy()
        for length in np.unique(lengths):
            at = np.nonzero(lengths == length)[0]
            unit, local = _units(np.stack(vectors["embedding"].to_numpy()[at])), np.zeros(len(vectors), np.int64)
            local[at] = np.arange(len(at))
            same = np.nonzero((lengths[i] == length) & (lengths[j] == length))[0]
            for part in (same[k : k + PAIRS] for k in range(0, len(same), PAIRS)):
                x, y, places = local[i[part]], local[j[part]], place[part]
                near = (unit[x] * unit[y]).sum(axis=1) >= limit
                x, y, places = x[near], y[near], places[near]
                here = _met_here(lambda t, rows: _cells(unit[rows], t, scale), x, y, places)  # noqa: B023
                x, y = at[x[here]], at[y[here]]
                node, copies, linked_to = vectors["a"].to_numpy(), vectors["b"].to_numpy(), np.zeros(len(vectors), np.int64)
                np.add.at(linked_to, x, copies[y])
                np.add.at(linked_to, y, copies[x])
                counted, needed = np.nonzero(linked_to)[0], _tree(node[x], node[y])
                yield pd.DataFrame({"kind": "count", "a": node[counted], "b": linked_to[counted]})
                yield pd.DataFrame({"kind": "tie", "a": node[x[needed]], "b": node[y[needed]]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # vectors of a star whose pairs may go on in the next batch
        for batch in batches:
            is_pair = batch["place"].to_numpy() >= 0
            vectors = batch[~is_pair] if held is None else pd.concat([held, batch[~is_pair]])
            if is_pair.any():
                yield from found(vectors, batch[is_pair])
            held = vectors[vectors["star"].to_numpy() == batch["star"].iloc[-1]] if len(batch) else held

    return check


def _forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the link matrix (rows a, columns b) connects."""
    out, rows_left, columns_left = [], np.ones(len(a), bool), np.ones(len(b), bool)
    for first in range(len(a)):
        wave = np.array([first]) if rows_left[first] and links[first].any() else np.zeros(0, int)
        rows_left[first] = False
        while len(wave):
            hit = links[wave] & columns_left
            columns = np.nonzero(hit.any(axis=0))[0]
            out += [(int(a[wave[hit[:, c].argmax()]]), int(b[c])) for c in columns]
            columns_left[columns] = False
            back = links[:, columns] & rows_left[:, None]
            wave = np.nonzero(back.any(axis=1))[0]
            out += [(int(a[r]), int(b[columns[back[r].argmax()]])) for r in wave]
            rows_left[wave] = False
    return out


def _blocks(limit: float, scale: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table, low, high = int(key[1]), int(key[2]), int(key[3])
        lengths = rows["embedding"].map(len)
        rows = rows[lengths == lengths.iloc[0]]  # one cell, one length
        unit = _units(np.stack(rows["embedding"].to_numpy()))
        node, copies, mine, chunk = (rows[c].to_numpy() for c in ("node", "copies", "is_own", "chunk"))
        linked_to = np.zeros(len(rows), np.int64)
        ties: list[tuple[int, int]] = []
        left, right = np.nonzero(chunk == low)[0], np.nonzero(chunk == high)[0]
        all_cells = functools.cache(lambda t: _cells(unit, t, scale))

        def cells(t: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own, probed = all_cells(t)
            return own[some], probed[some]

        def meet(i: np.ndarray, j: np.ndarray, both_own: bool, twice: bool) -> None:
            """Count the links between rows i, which own the cell, and j, that meet here first; twice if i and j are the same rows."""
            links = unit[i] @ unit[j].T >= limit
            x, y = np.nonzero(links)
            for part in range(0, len(x), PAIRS):
                p, q = i[x[part : part + PAIRS]], j[y[part : part + PAIRS]]
                swap = node[p] > node[q]
                place = 4 * table + (np.zeros(len(p), int) if both_own else np.where(swap, 2, 1))
                here = _met_here(cells, np.where(swap, q, p), np.where(swap, p, q), place) & (node[p] != node[q])
                if twice:  # every pair is there both ways
                    here &= ~swap
                links[x[part : part + PAIRS], y[part : part + PAIRS]] = here
            np.add.at(linked_to, i, links @ copies[j])
            np.add.at(linked_to, j, links.T @ copies[i])
            ties.extend(_forest(links, node[i], node[j]))

        meet(left[mine[left]], right[mine[right]], True, low == high)
        meet(left[mine[left]], right[~mine[right]], False, False)
        if low != high:
            meet(right[mine[right]], left[~mine[left]], False, False)
        counted = np.nonzero(linked_to)[0]
        out = [("count", int(node[k]), int(linked_to[k])) for k in counted] + [("tie", u, v) for u, v in ties]
        return pd.DataFrame(out, columns=["kind", "a", "b"])

    return compare


def _rounds(rows: dict[int, int], most: int) -> list[list[int]]:
    """Tables in order, dealt to rounds of at most so many rows (or one table)."""
    out, held = [], 0
    for table in sorted(rows):
        if not out or held + rows[table] > most:
            out, held = [*out, []], 0
        out[-1].append(table)
        held += rows[table]
    return out


def link(nodes: DataFrame, limit: float = COSINE, scale: float = SCALE_50K) -> tuple[DataFrame, DataFrame]:
    """From distinct vectors (node, copies, embedding): numbers of linked vectors (node, n), and links (u, v) that connect them."""
    nodes = stored(nodes.select("node", "copies", "embedding"))
    n = nodes.count()

    met = []
    for tables in _rounds({t: n * (PROBES + 1) for t in range(tables_at(scale))}, ENTRIES):
        entries = nodes.select("node", "embedding").mapInArrow(_indexer(tables, scale), "key long, node long, what int, low long, high long")
        in_cells = entries.repartition("key").sortWithinPartitions("key")
        met.append(stored(in_cells.mapInArrow(_cell_pairs(limit, LARGE), "key long, a long, b long, place int, is_pair boolean")))
    met = functools.reduce(DataFrame.unionByName, met)

    # a star is a node and the nodes above it: vectors go to the stars of their pairs, once to each
    pairs = stored(met.where("is_pair").groupBy("a", "b").agg(F.min("place").alias("place")))
    below = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("star"))
    pairs = stored(pairs.join(below, "a", "left").select(F.coalesce("star", "a").alias("star"), "a", "b", "place"))
    members = pairs.select("star", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    vectors = members.select("star", F.col("node").alias("a"), F.col("copies").alias("b"), F.lit(-1).alias("place"), "embedding")
    told = vectors.unionByName(pairs.withColumn("embedding", F.lit(None).cast(nodes.schema["embedding"].dataType)))
    in_stars = told.repartition("star").sortWithinPartitions("star", F.col("place") >= 0)
    results = [stored(in_stars.mapInPandas(_check_pairs(limit, scale), KINDS))]

    large = met.where("NOT is_pair").select("key", F.col("a").alias("node"), F.floor(F.col("place") / 2).cast("int").alias("tab"), (F.col("place") % 2 == 1).alias("is_own"))
    sizes = large.groupBy("key", "tab").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_own").alias("owners")).where("owners > 0")
    sizes = stored(sizes.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")))
    by_table = dict(sizes.groupBy("tab").agg(F.sum(F.col("size") * F.col("chunks"))).collect())
    for tables in _rounds(by_table, max(n, ENTRIES // (PROBES + 1))):
        some = large.where(F.col("tab").isin(tables)).join(sizes.where(F.col("tab").isin(tables)).select("key", "chunks"), "key")
        dealt = some.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("chunks", "other")
        results.append(stored(dealt.join(nodes, "node").groupBy("key", "tab", "low", "high").applyInPandas(_blocks(limit, scale), KINDS)))
    results = functools.reduce(DataFrame.unionByName, results)
    counts = results.where("kind = 'count'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    return counts, results.where("kind = 'tie'").select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_copies(embeddings: DataFrame, limit: float = COSINE, scale: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    with freed(embeddings.sparkSession):
        return _near_copies(embeddings, limit, scale)


def _near_copies(embeddings: DataFrame, limit: float, scale: float | None) -> DataFrame:
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = slim.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    # a vector goes by its 64-bit hash; one id with several vectors: a node for each vector, but one component
    node = F.xxhash64(F.col("embedding").cast("array<double>")).alias("node")
    ids = cut(sound.select("vec_id", node).distinct())
    sizes = cut(ids.groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    hot = hot_keys(sizes, "copies", ids.count()).select("node")
    vectors = sound.select(node, "embedding").dropDuplicates(["node"])
    nodes = sizes.join(vectors, "node")
    if scale is None:
        scale = float(np.clip(SCALE_50K * (max(1, sizes.count()) / 50_000) ** 0.125, LEAST_SCALE, MOST_SCALE))
    counts, ties = link(nodes.select("node", "copies", "embedding"), limit, scale)
    known = cut(join_facts(ids, sizes.join(counts, "node", "left").select("node", "first", "copies", F.coalesce("n", F.lit(0)).alias("n")), ["node"], hot, ["vec_id"]))
    firsts = sizes.select("node", "first")
    by_id = ties.join(firsts.select(F.col("node").alias("u"), F.col("first").alias("p")), "u").join(
        firsts.select(F.col("node").alias("v"), F.col("first").alias("q")), "v"
    ).select(F.col("p").alias("u"), F.col("q").alias("v"))
    copies = known.select(F.col("vec_id").alias("u"), F.col("first").alias("v"))
    found = components(by_id.unionByName(copies))
    links = known.groupBy("vec_id").agg(F.sum(F.col("n") + F.col("copies") - 1).alias("n_links")).join(
        found.select(F.col("node").alias("vec_id"), F.col("component").alias("component_id")), "vec_id", "left"
    )
    return slim.select("vec_id").join(links, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = f"""
    WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
    both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach(vec_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
    n AS (SELECT u, count(*) AS n FROM both_ways GROUP BY u)
    SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.vec_id = m.c AS kept
    FROM (SELECT vec_id, min(other) AS c FROM reach GROUP BY 1) m LEFT JOIN n ON n.u = m.vec_id"""
