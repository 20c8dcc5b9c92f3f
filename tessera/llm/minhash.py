"""MinHash near-duplicates: universal hash minima, banding, signature and exact verification, components.

A document's set holds its distinct shingles of ``SHINGLE`` words as 64-bit hashes. Documents with equal
sets form a class, of which the least id stands for all. Representatives that share one of ``BANDS``
bands of ``ROWS`` minima are candidates, but pairs within a band's bucket are not all made:

1. every member of a bucket is paired with one hub, the member that shares most buckets with others;
2. where a bucket still spans several components, members are paired with up to ``HUBS`` more hubs of
   other components;
3. where it still does, all pairs across components are tested: by a join in buckets of up to ``SMALL``
   members; in larger ones inside blocks of ``CHUNK`` by ``CHUNK`` members. Members of a bucket's largest
   component meet only those outside it. Signatures alone travel to the blocks at first; the texts follow
   of those members only that have a partner of like signature there, and links alone come back.

Pairs are verified first by signature (at least ``SIGNATURE`` of the minima agree), then on the full sets
(100 * intersection >= ``PERCENT`` * union), and components are found anew after each step. A group of
near copies so costs a few tests per document and bucket, and no link between two components is left
untested once its pair shares a bucket. Blocks test a pair in the first band that it shares, and skip
pairs that links found before have already connected.

Defined results: words are separated by space and U+0009 to U+000D, A-Z count as a-z; fewer than SHINGLE
words are one shingle; null text or text without words has an empty set and links with nothing, as do
rows with a null id (component_id null, kept true); rows with one id are one document whose texts all
count; an empty table gives no rows; extra columns are ignored; long texts are hashed in blocks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, hot_keys, join_facts
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
PERCENT = 75
SIGNATURE = 0.6
HUBS = 3
SMALL = 16
#: Members of a bucket that are compared with others as one block.
CHUNK = 512
BLOCK = 1 << 22
#: Powers of the words' base that a worker keeps, enough for most texts (0.5 MB, where those of a whole block are 34).
KEPT = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Ids whose texts are looked up by a broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000
_BLOCK = ["key", "band", "low", "high", "doc_id", "c", "chunk", "signature"]
_SKETCH = "doc_id long, n_shingles long, digest binary, signature binary"


@functools.cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """Random bytes' values, place factors, multipliers and offsets of the minima, and the words' base."""
    rng = np.random.default_rng(20)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(256), draw(SHINGLE), draw(PERMUTATIONS), draw(PERMUTATIONS), draw(1)[0]


@functools.cache
def _powers(inverse: bool) -> np.ndarray:
    """The first KEPT powers of the words' base, or of its inverse: a worker keeps them."""
    return _accumulated(inverse, 1, KEPT)


def _accumulated(inverse: bool, step: int, n: int) -> np.ndarray:
    base = int(_constants()[4])
    out = np.full(n, pow(base, -step if inverse else step, 1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _first_powers(inverse: bool, n: int) -> np.ndarray:
    """The first n powers; those beyond KEPT are made for the block at hand."""
    low = _powers(inverse)
    return low[:n] if n <= KEPT else np.multiply.outer(_accumulated(inverse, KEPT, -(-n // KEPT)), low).ravel()[:n]


def _word_hashes(block: bytes) -> np.ndarray:
    """A 64-bit polynomial hash of every word of the lower-cased bytes."""
    raw = np.frombuffer(block, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    change = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, ends = change[::2], change[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_constants()[0][raw] * _first_powers(False, len(raw)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _first_powers(True, len(raw))[starts] + (ends - starts).astype(np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _long_word_hash(data: bytes, start: int, end: int) -> np.ndarray:
    """The same hash of one word of any length, summed up in blocks."""
    base, total = int(_constants()[4]), 0
    for at in range(start, end, BLOCK):
        raw = np.frombuffer(data, np.uint8, min(BLOCK, end - at), at)
        total += int((_constants()[0][raw] * _first_powers(False, len(raw))).sum(dtype=np.uint64)) * pow(base, at - start, 1 << 64)
    return _mixed(np.array([(total + end - start) % (1 << 64)], np.uint64))


def _all_hashes(data: bytes) -> Iterator[np.ndarray]:
    """The hashes of a text's words, in blocks that end between words; a word longer than a block is a block of its own."""
    start = 0
    while len(data) - start > BLOCK:
        end = max(data.rfind(c, start, start + BLOCK) for c in (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")) + 1
        if end > start:
            yield _word_hashes(data[start:end])
        else:
            found = _SPACE.search(data, start + BLOCK)
            end = found.start() if found else len(data)
            yield _long_word_hash(data, start, end)
        start = end
    yield _word_hashes(data[start:])


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = np.concatenate(list(_all_hashes((text or "").encode("utf-8", "replace").lower())))
    place = _constants()[1]
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return np.array([(words * place[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)
    out = words[: n - SHINGLE + 1] * place[0]
    for j in range(1, SHINGLE):
        out += words[j : n - SHINGLE + 1 + j] * place[j]
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set, as PERMUTATIONS uint32."""
    _, _, factor, offset, _ = _constants()
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(least, (shingles[a : a + 512, None] * factor + offset).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            found = shingle_set(text if isinstance(text, str) else None)
            if len(found):
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), minima(found).tobytes()))
            else:
                rows.append((0, None, None))
        out = pd.DataFrame(rows, columns=["n_shingles", "digest", "signature"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy() if not batch["doc_id"].isna().any() else batch["doc_id"].astype("Int64").array)
        yield out


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(len(batch), PERMUTATIONS) for c in ("sig_a", "sig_b"))
            yield batch.loc[(a == b).mean(axis=1) >= SIGNATURE, ["a", "b"]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last_id, last_text, last_set = None, None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if a != last_id or ta != last_text:
                last_id, last_text, last_set = a, ta, shingle_set(ta)
            other = shingle_set(tb)
            common = _common(last_set, other) if len(other) and len(last_set) else 0
            keep.append(0 < common and 100 * common >= PERCENT * (len(last_set) + len(other) - common))
        yield batch.loc[keep, ["a", "b"]]


def _verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that stand both tests, as links (u, v)."""
    with_a = signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"))
    with_b = signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"))
    alike = pairs.join(with_a, "a").join(with_b, "b").select("a", "b", "sig_a", "sig_b").mapInPandas(_alike, "a long, b long")
    alike = cut(alike.distinct())
    # a hub's text goes to as many tasks as its partners are dealt to
    n = alike.count()
    hot = {c: hot_keys(alike.groupBy(c).agg(F.count(F.lit(1)).alias("n")), "n", n).select(c) for c in ("a", "b")}
    text_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    text_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    with_text = join_facts(alike, text_b, ["b"], hot["b"], ["a"])
    full = join_facts(with_text, text_a, ["a"], hot["a"], ["b"]).select("a", "b", "text_a", "text_b")
    return full.mapInPandas(_linked, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _like_in_block(key: tuple, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j of pairs of like signature in two chunks, of different components so far and first met in this band; and how much they agree."""
    band, low, high = int(key[1]), int(key[2]), int(key[3])
    minima_of = np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(len(rows), BANDS, ROWS)
    ids, groups, chunk = (rows[c].to_numpy() for c in ("doc_id", "c", "chunk"))
    i, j = np.nonzero(chunk == low)[0], np.nonzero(chunk == high)[0]
    agree = np.zeros((len(i), len(j)), np.int16)
    usable = groups[i][:, None] != groups[j][None, :]
    for b in range(BANDS):
        whole = np.ones(agree.shape, bool)
        for r in range(ROWS):
            same = minima_of[i, b, r][:, None] == minima_of[j, b, r][None, :]
            agree += same
            whole &= same
        if b < band:
            usable &= ~whole
    if low == high:
        usable &= ids[i][:, None] < ids[j][None, :]
    x, y = np.nonzero(usable & (agree >= SIGNATURE * PERMUTATIONS))
    return i[x], j[y], agree[x, y]


def _partnered_in_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The members of a block that have a partner of like signature in it."""
    i, j, _ = _like_in_block(key, rows)
    return rows.iloc[np.unique(np.concatenate([i, j]))][_BLOCK]


def _links_in_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between members of two chunks of a bucket that lie in different components so far."""
    ids, groups, texts = (rows[c].to_numpy() for c in ("doc_id", "c", "text"))
    i, j, agree = _like_in_block(key, rows)
    order = np.argsort(-agree, kind="stable")
    parent: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    sets: dict[int, np.ndarray] = {}
    out = []
    for k in order.tolist():
        p, q = int(i[k]), int(j[k])
        cp, cq = top(int(groups[p])), top(int(groups[q]))
        if cp == cq:
            continue
        for m in (p, q):
            if m not in sets:
                sets[m] = shingle_set(texts[m])
        common = _common(sets[p], sets[q])
        if common and 100 * common >= PERCENT * (len(sets[p]) + len(sets[q]) - common):
            parent[max(cp, cq)] = min(cp, cq)
            out.append((int(ids[p]), int(ids[q])))
    return pd.DataFrame(out, columns=["u", "v"])


def _pairs(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _representative_links(documents: DataFrame, sketches: DataFrame) -> DataFrame:
    """component of every representative that is linked: node, component."""
    signatures = cut(sketches.select("doc_id", "signature").distinct())
    band_key = F.xxhash64("band", F.expr(f"substring(signature, {4 * ROWS} * band + 1, {4 * ROWS})"))
    keys = signatures.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).select(band_key.alias("key"), "doc_id", "band")
    sizes = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    hot = cut(hot_keys(sizes, "size", BANDS * signatures.count()).select("key"))
    buckets = cut(join_facts(keys, sizes, ["key"], hot, ["doc_id"]))
    weights = buckets.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    ids = cut(weights.select("doc_id"))
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = cut(documents.where(F.col("text").isNotNull()).join(near, "doc_id", "left_semi"))
    signatures = cut(signatures.join(near, "doc_id", "left_semi"))

    hubs = buckets.join(weights, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub"))
    first = join_facts(buckets, hubs, ["key"], hot, ["doc_id"]).where("doc_id != hub").select(*_pairs("doc_id", "hub")).distinct()
    tested = cut(first)
    links = cut(_verified(tested, signatures, texts))
    for step in ("hubs", "rest"):
        found = cut(components(links))
        state = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        state = state.select("key", "band", "size", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        spread = state.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        state = cut(join_facts(state, spread, ["key"], hot, ["doc_id"]))
        pairs = _by_hubs(state) if step == "hubs" else _in_small_buckets(state)
        more = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(more)
        new = _verified(more, signatures, texts)
        if step == "rest":
            new = new.unionByName(_in_large_buckets(state, signatures, texts))
        links = cut(links.unionByName(new))
    return components(links)


def _joined(state: DataFrame, other: DataFrame, ordered: bool) -> DataFrame:
    order = F.col("doc_id") < F.col("hub") if ordered else F.col("doc_id") != F.col("hub")
    met = state.select("key", "doc_id", "c").join(other, "key").where((F.col("c") != F.col("hub_c")) & order)
    return met.select(*_pairs("doc_id", "hub"))


def _by_hubs(state: DataFrame) -> DataFrame:
    slot = F.pmod(F.xxhash64("doc_id", "key"), F.lit(HUBS))
    other = state.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("doc_id", "c")).alias("o"))
    return _joined(state, other.select("key", F.col("o.doc_id").alias("hub"), F.col("o.c").alias("hub_c")), ordered=False)


def _in_small_buckets(state: DataFrame) -> DataFrame:
    small = state.where(F.col("size") <= SMALL)
    return _joined(small, small.select("key", F.col("doc_id").alias("hub"), F.col("c").alias("hub_c")), ordered=True)


def _in_large_buckets(state: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    large = state.where(F.col("size") > SMALL)
    parts = large.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "c")).alias("m")).select("key", F.col("m.c").alias("main"), F.col("m.n").alias("n"))
    # chunks below first hold the largest component, those from first on all others; two of the former never meet
    first, rest = F.ceil(F.col("n") / CHUNK).cast("int"), F.ceil((F.col("size") - F.col("n")) / CHUNK).cast("int")
    dealt = large.join(main, "key").withColumn("first", first).withColumn("rest", rest)
    hashed = F.xxhash64("doc_id")
    chunk = F.when(F.col("c") == F.col("main"), F.pmod(hashed, F.col("first"))).otherwise(F.col("first") + F.pmod(hashed, F.col("rest")))
    start = F.when(F.col("c") == F.col("main"), F.col("first")).otherwise(0)
    dealt = dealt.withColumn("chunk", chunk.cast("int")).withColumn("other", F.explode(F.sequence(start, F.col("first") + F.col("rest") - 1)))
    dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    blocks = ["key", "band", "low", "high"]
    schema = "key long, band int, low int, high int, doc_id long, c long, chunk int, signature binary"
    partnered = cut(dealt.join(signatures, "doc_id").select(*_BLOCK).groupBy(*blocks).applyInPandas(_partnered_in_block, schema))
    return partnered.join(texts.select("doc_id", "text"), "doc_id").groupBy(*blocks).applyInPandas(_links_in_block, "u long, v long")


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    bounded_batches(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut(slim.mapInPandas(_sketch, _SKETCH))
    usable = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    standing = usable.join(classes, (usable["digest"] == classes["digest"]) & (usable["doc_id"] == classes["class_id"]), "left_semi")
    found = _representative_links(slim, standing)
    members = usable.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id").distinct()
    of_id = members.groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    several = of_id.where("low < high")
    if not several.isEmpty():  # ids with several texts tie these texts' classes together
        ties = members.join(several, "doc_id").select(F.col("class_id").alias("u"), F.col("low").alias("v"))
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(ties))
    found = found.select(F.col("node").alias("low"), "component")
    by_id = of_id.join(found, "low", "left").select("doc_id", F.coalesce("component", "low").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """The documents of which no near copy with a smaller id exists, one row each, with their own columns.

    Of rows that share an id the one stays whose columns, as JSON, have the least digest; rows with a null id all stay.
    """
    gone = cut(near_copies(documents).where("NOT kept").select("doc_id").distinct())
    left = documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(documents.columns)
    several = cut(documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    n = several.count()
    if n == 0:
        return left
    several = F.broadcast(several) if n <= BROADCAST_IDS else several
    row = F.struct(*[F.col(c) for c in documents.columns])
    one = left.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row")).select("_row.*")
    return left.join(several, "doc_id", "left_anti").select(documents.columns).unionByName(one)


ORACLE_SQL = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
    both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.other)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM documents d JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
