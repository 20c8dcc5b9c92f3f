"""Sparse, dense and fused retrieval with exact top-k."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import STEM_FROM, STEM_LETTERS, STEM_WEIGHT, STOP_WORDS, lower, stem
from . import nearest
from .durable import cut, stored

#: Postings of a block, postings of a shard of a very frequent term, and more than rounding can change a score.
BLOCK, SHARD, ROUNDING = 256, 100_000, 2e-6
#: Postings of queries up to which queries are held in every task, numbers of a matrix and documents of a product there, postings of a batch of Arrow.
ASKED, MATRIX, ROWS, BATCH = 200_000, 4 << 20, 512, 200_000
# Fixed value: what a token is.
TOKEN = "[0-9]+(?:[.,/][0-9]+)*|[a-zçğıöşüâîû]+"


def tokens(text: Column) -> Column:
    """The lower-cased text's tokens in order, stop words left out."""
    found = F.regexp_extract_all(lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def _counted(key: str):
    """A function over batches (key, lower-cased text) that counts each text's terms."""
    token, stop = re.compile(TOKEN), frozenset(STOP_WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, weights = [], [], []

            def packed(rows: list = rows, terms: list = terms, weights: list = weights, keys: pa.Array = batch.column(0)) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int32())), pa.array(terms, pa.string()), pa.array(weights, pa.float64())], [key, "term", "tf"])
                rows.clear(), terms.clear(), weights.clear()
                return out

            for i, text in enumerate(batch.column(1)):
                said, stems = Counter(token.findall(text.as_py())), Counter()
                for word, n in said.items():
                    if word not in stop:
                        terms.append(word)
                        weights.append(float(n))
                        if len(word) >= STEM_FROM:
                            stems["~" + word[:STEM_LETTERS]] += n
                terms.extend(stems)
                weights.extend(round(STEM_WEIGHT * n, 6) for n in stems.values())
                rows.extend([i] * (len(terms) - len(rows)))
                if len(rows) >= BATCH:
                    yield packed()
            yield packed()

    return count


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: every token weighs 1; a long one's stem, marked by ~, weighs less besides.

    A text's terms are counted where it is read, so postings aren't shuffled. Only where a key has several texts are their postings summed
    by a shuffle; whether one has is looked up in the keys alone when this is called.
    """
    kind = df.schema[key].dataType.simpleString()
    said = df.where(F.col(text).isNotNull()).select(key, lower(F.col(text)).alias("_said"))
    found = said.mapInArrow(_counted(key), f"`{key}` {kind}, term string, tf double")
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return found
    return found.groupBy(key, "term").agg(F.round(F.sum("tf"), 6).alias("tf"))


def hashed_vectors(held: DataFrame, key: str, size: int = 16) -> DataFrame:
    """key, embedding: texts as vectors of their terms' hashed numbers (size up to 32), for want of a model; like terms give like vectors.

    Each component is summed over a text's postings; no vector is made of more than one text's.
    """
    md5 = F.md5(F.col("term").cast("binary"))
    # eight digits are one number, of which each is a part
    eights = [F.conv(F.substring(md5, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_e{i}") for i in range(-(-size // 8))]
    digit = lambda i: F.shiftright(F.col(f"_e{i // 8}"), 28 - 4 * (i % 8)).bitwiseAND(F.lit(15).cast("long")).cast("double") - 7.5
    sums = [F.sum(F.col("tf") * digit(i)) for i in range(size)]
    return held.select(key, "tf", *eights).groupBy(key).agg(F.array(*sums).alias("embedding"))


def overlap(query: Column, found: Column) -> Column:
    """The share of a question's tokens that texts found hold, as they are or by their stem; null without tokens."""
    asked, there = tokens(query), tokens(found)
    stems = F.filter(F.transform(there, stem), lambda x: x.isNotNull())
    hits = F.filter(asked, lambda t: F.array_contains(there, t) | F.coalesce(F.array_contains(stems, stem(t)), F.lit(False)))
    return F.size(hits) / F.nullif(F.size(asked), F.lit(0))


def sufficient(query: Column, found: Column, few: int = 2, least: float = 0.6) -> Column:
    """Whether texts found can answer: of up to few tokens one must be there, of more the share least."""
    share = F.coalesce(overlap(query, found), F.lit(0.0))
    return F.when(F.size(tokens(query)) <= few, share > 0).otherwise(share >= least)


def dense_search(queries: DataFrame, vectors: DataFrame, query: str, doc: str, k: int, vector: str = "embedding", payload: Column | None = None) -> DataFrame:
    """query, doc, score, position: the k nearest by cosine, exactly; null and zero vectors meet nothing.

    Vectors whose payload doesn't fit are left out before anything is compared. See operators.nearest for how few comparisons do.
    """
    held = vectors if payload is None else vectors.where(payload)
    return top(nearest.search(queries, held, query, doc, k, vector), query, doc, k)


def recall_at(found: DataFrame, expected: DataFrame, query: str, doc: str, category: str, ks: tuple[int, ...]) -> DataFrame:
    """category, n, recall_<k>..: the share of questions with an expected document (query, category, doc) among their k best; null category: all.

    Questions without expected documents aren't in expected, and don't count.
    """
    best = found.join(expected.select(query, doc), [query, doc], "left_semi").groupBy(query).agg(F.min("position").alias("_best"))
    asked = expected.select(query, category).distinct().join(best, query, "left")
    shares = [F.round(F.avg(F.coalesce(F.col("_best") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}") for k in ks]
    return asked.rollup(category).agg(F.count(F.lit(1)).alias("n"), *shares)


def posting_blocks(held: DataFrame, doc: str, size: int = BLOCK) -> DataFrame:
    """term, top (the block's largest tf), first (whether the block holds the term's largest), n, held (structs of doc and tf): an index of postings by impact.

    A term's postings are ordered by tf and cut into blocks, the largest first; those of very frequent terms are dealt to shards that are
    ordered each by itself. Terms with over a 4096th of all postings are fewer than 4096, and their list is broadcast.
    """
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    often = counts.where(F.col("_n") > max(SHARD, total // 4096)).select("term", F.ceil(F.col("_n") / SHARD).alias("_shards"))
    rows = held.join(F.broadcast(often), "term", "left").withColumn("_shard", F.pmod(F.xxhash64(doc), F.coalesce("_shards", F.lit(1))))
    place = F.row_number().over(Window.partitionBy("term", "_shard").orderBy(F.desc("tf"), doc)) - 1
    groups = rows.withColumn("_block", F.floor(place / size)).groupBy("term", "_shard", "_block")
    return groups.agg(F.max("tf").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(F.col(doc), "tf")).alias("held")).select(
        "term", "top", (F.col("_block") == 0).alias("first"), "n", "held"
    )


def _weighed(queries: DataFrame, blocks: DataFrame, query: str, n_docs: DataFrame) -> DataFrame:
    """query, term, weight, most (the most that the term can add to a score), others (the most that all other terms of the query can)."""
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")).crossJoin(F.broadcast(n_docs))
    idf = terms.select("term", "top", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = queries.join(idf, "term").select(query, "term", (F.col("tf") * F.col("idf")).alias("weight"), "top").withColumn("most", F.col("weight") * F.col("top"))
    return asked.select(query, "term", "weight", "most", (F.sum("most").over(Window.partitionBy(query)) - F.col("most")).alias("others"))


def _scored(pairs: DataFrame, query: str, doc: str) -> DataFrame:
    """query, doc, score from pairs (query, weight, held, least) over those postings whose tf is at least least."""
    each = pairs.select(query, "weight", "least", F.explode("held").alias("_h")).where(F.col("_h.tf") >= F.col("least"))
    return each.groupBy(query, F.col(f"_h.{doc}").alias(doc)).agg(F.round(F.sum(F.col("weight") * F.col("_h.tf")), 6).alias("score"))


def pruned_pairs(queries: DataFrame, blocks: DataFrame, query: str, doc: str, n_docs: DataFrame, k: int) -> DataFrame:
    """query, term, weight, least, n, held: the blocks that can hold a posting of one of the query's k best documents.

    The first blocks of a query's terms give scores that are no higher than the whole ones, so their k-th is a bound that the k best reach.
    A posting whose own part and the most of all other terms together stay below it belongs to none of them, nor does its block if that holds
    for the block's largest. A document of the k best so keeps all its postings, and others only lose: the result is exact.
    """
    asked = _weighed(queries, blocks, query, n_docs)
    start = asked.join(blocks.where("first"), "term").select(query, "weight", F.lit(0.0).alias("least"), "held")
    bound = top(_scored(start, query, doc), query, doc, k).where(F.col("position") == k).select(query, (F.col("score") - ROUNDING).alias("bound"))
    least = F.coalesce((F.col("bound") - F.col("others")) / F.col("weight"), F.lit(0.0))
    wanted = asked.join(bound, query, "left").select(query, "term", "weight", least.alias("least"))
    return wanted.join(blocks, "term").where(F.col("top") >= F.col("least")).select(query, "term", "weight", "least", "n", "held")


class _Asked:
    """A bounded set of queries as numbers: term and weight of each posting by query, for products in tasks."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int, n_terms: int, k: int) -> None:
        self.query, self.term, self.weight, self.n_queries, self.n_terms, self.k = query, term, weight, n_queries, n_terms, k
        self.wide = max(1, MATRIX // max(1, n_terms))  # queries of a matrix
        self.tall = max(1, min(ROWS, MATRIX // max(1, n_terms), MATRIX // max(1, min(self.wide, n_queries))))  # documents of one

    def matrix(self, start: int) -> np.ndarray:
        """Weights by term and query, for the queries from start on."""
        own = (self.query >= start) & (self.query < start + self.wide)
        out = np.zeros((self.n_terms, min(self.wide, self.n_queries - start)))
        out[self.term[own], self.query[own] - start] = self.weight[own]
        return out

    def best(self, doc: str, kind: str):
        """A function over batches (doc, _t, tf) in the order of doc: _q, doc, score of the k best of a task for each query, the first of equals."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bound, found = np.full(self.n_queries, -1.0), [([], []) for _ in range(self.n_queries)]
            whole = self.matrix(0) if self.wide >= self.n_queries else None

            def product(docs: pa.Array, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
                held = np.zeros((len(docs), self.n_terms))
                held[row, term] = tf
                for start in range(0, self.n_queries, self.wide):
                    raw = held @ (self.matrix(start) if whole is None else whole)
                    scores = np.where(raw > 0, np.round(raw, 6), -1.0)  # without a shared term there is no score
                    least = bound[start : start + scores.shape[1]]
                    # a document behind others of the same score comes after them, so those of the k-th found before don't count
                    own = np.partition(scores, -self.k, axis=0)[-self.k] if len(docs) >= self.k else np.full(scores.shape[1], -1.0)
                    for r, q in zip(*np.nonzero((scores > least) & (scores >= own)), strict=True):
                        made, names = found[start + q]
                        made.append(scores[r, q])
                        names.append(docs[int(r)])
                    for q in np.flatnonzero((scores > least).any(axis=0)) + start:
                        made, names = found[q]
                        order = np.argsort(-np.array(made), kind="stable")[: self.k]
                        found[q] = ([made[i] for i in order], [names[i] for i in order])
                        if len(order) == self.k:
                            bound[q] = found[q][0][-1]

            left: pa.Table | None = None
            for table in _tables(batches):
                table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
                runs = pc.run_end_encode(table.column(0).combine_chunks())
                ends = runs.run_ends.to_numpy()
                # the last document may go on in what comes next
                whole_rows = int(ends[-2]) if len(ends) > 1 else 0
                self._products(product, table.slice(0, whole_rows), runs.values.slice(0, len(ends) - 1), ends[:-1])
                left = table.slice(whole_rows)
            if left is not None:
                self._products(product, left, left.column(0).combine_chunks().slice(0, 1), np.array([left.num_rows]))
            names = [x.as_py() for _, d in found for x in d]
            query = np.repeat(np.arange(self.n_queries), [len(s) for s, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(names, kind), pa.array([x for s, _ in found for x in s], pa.float64())], ["_q", doc, "score"])

        return score

    def _products(self, product, table: pa.Table, docs: pa.Array, ends: np.ndarray) -> None:
        term, tf = table.column(1).to_numpy(), table.column(2).to_numpy()
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for i in range(0, len(docs), self.tall):
            some = slice(i, i + self.tall)
            first, last = int(starts[some][0]), int(ends[some][-1])
            row = np.repeat(np.arange(len(ends[some])), ends[some] - starts[some])
            product(docs.slice(i, self.tall), row, term[first:last], tf[first:last])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to about BATCH rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _few_asked(queries: DataFrame, docs: DataFrame, query: str, doc: str, n_docs: DataFrame, k: int) -> DataFrame:
    """query, doc, score: the k best of each task for each of the queries, whose postings are few; among them those of all."""
    spark, kinds = queries.sparkSession, [queries.schema[query].dataType.simpleString(), docs.schema[doc].dataType]
    rows = queries.select(query, "term", "tf").collect()  # ASKED at most
    asks, terms = ({x: i for i, x in enumerate(dict.fromkeys(r[c] for r in rows))} for c in (0, 1))
    numbers = spark.createDataFrame(list(terms.items()), "term string, _t int")
    held = stored(docs.join(F.broadcast(numbers), "term").select(doc, "_t", "tf"))
    often = np.zeros(max(1, len(terms)))
    for r in held.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).collect():  # one number for each term asked for
        often[r["_t"]] = r["n"]
    q, t = (np.array([x[r[c]] for r in rows], dtype=np.int32) for c, x in ((0, asks), (1, terms)))
    idf = np.log(1 + ((n_docs.first()["n"] or 0) - often + 0.5) / (often + 0.5))
    own = _Asked(q, t, np.array([r[2] for r in rows], dtype=float) * idf[t], len(asks), max(1, len(terms)), k)
    ordered = held.repartition(doc).sortWithinPartitions(doc)
    best = ordered.mapInArrow(own.best(doc, to_arrow_type(kinds[1])), f"_q int, `{doc}` {kinds[1].simpleString()}, score double")
    back = spark.createDataFrame([(i, x) for x, i in asks.items()], f"_q int, `{query}` {kinds[0]}")
    return best.join(F.broadcast(back), "_q").select(query, doc, "score")


def sparse_search(queries: DataFrame, docs: DataFrame, query: str, doc: str, n_docs: DataFrame, k: int) -> DataFrame:
    """query, doc, score, position: sum of tf * tf * idf over shared terms, the k best of each query, exactly.

    queries and docs are postings; n_docs has the number of documents in n. idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Only postings of terms
    asked for travel. Up to ASKED postings of queries are held in every task, which multiplies them with blocks of whole documents and keeps
    the k best of each; with more of them postings meet in blocks by impact, and blocks that can't reach a query's k-th score are left out.
    """
    queries = cut(queries)
    if queries.count() <= ASKED:
        return top(_few_asked(queries, docs, query, doc, n_docs, k), query, doc, k)
    held = cut(docs.join(queries.select("term").distinct(), "term", "left_semi"))
    blocks = cut(posting_blocks(held, doc))
    return top(_scored(pruned_pairs(queries, blocks, query, doc, n_docs, k), query, doc), query, doc, k)


def top(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The k best documents of each query by score, ties by document, with their position from 1."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scores.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def fuse(left: DataFrame, right: DataFrame, query: str, doc: str, k: int, rank_constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists, the k best of each query."""
    term = lambda c: F.coalesce(1 / (F.lit(rank_constant) + F.col(c)), F.lit(0.0))
    both = left.select(query, doc, F.col("position").alias("a")).join(right.select(query, doc, F.col("position").alias("b")), [query, doc], "full_outer")
    return top(both.select(query, doc, F.round(term("a") + term("b"), 8).alias("score")), query, doc, k)


def containing(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, size: int = 5) -> DataFrame:
    """doc, item of the documents that hold an item's text as it is.

    Candidates share the hash of one inner window of words, the item's with the least hash; texts are then compared in
    full. Items with fewer than size + 2 words have no whole inner window and are few by nature; they are compared with every document.
    """
    words = lambda c: F.split(c, "[ \\t\\n\\x0B\\f\\r]+")
    windows = lambda w, start, end: F.transform(F.sequence(start, end), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    held = items.select(F.col(item), F.col(text).alias("_item"), words(F.col(text)).alias("_w")).where("_item IS NOT NULL")
    n = F.size("_w")
    keyed = held.where(n >= size + 2).select(item, "_item", F.array_min(windows(F.col("_w"), F.lit(2), n - size)).alias("_key"))
    texts = docs.select(F.col(doc), F.col(text).alias("_doc"), words(F.col(text)).alias("_w")).where("_doc IS NOT NULL")
    spread = texts.where(n >= size).select(doc, F.explode(F.array_distinct(windows(F.col("_w"), F.lit(1), n - size + 1))).alias("_key"))
    met = spread.join(keyed.select(item, "_key"), "_key").select(doc, item).distinct()
    sure = met.join(keyed.select(item, "_item"), item).join(texts.select(doc, "_doc"), doc).where(F.contains("_doc", "_item")).select(doc, item)
    short = held.where(n < size + 2).select(item, "_item")
    return sure.unionByName(texts.select(doc, "_doc").join(short, F.contains("_doc", "_item")).select(doc, item)).distinct()
