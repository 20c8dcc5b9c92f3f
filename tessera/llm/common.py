"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import cut, shared_dir  # noqa: F401 (for the operators)

#: The white space that separates words: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\f\r"
#: Keys with over 1 / HOT of all rows are hot: fewer than HOT of them, so they are broadcast. Each is dealt to PARTS salts.
HOT, PARTS = 4096, 256


#: Most rows and bytes of texts that Spark hands to a Python worker at once; a single longer row goes by itself.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower this session's limits of a batch for Python to those of BATCH: 10,000 texts of some KB are copied in the executor and in the worker."""
    for key, most in BATCH.items():
        now = _bytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    """A setting's number, maybe with a unit of bytes."""
    n, unit = re.fullmatch(r"(-?[0-9]+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(n) << 10 * "bkmgt".index(unit[0] if unit else "b")


def hot_keys(counts: DataFrame, n: str, rows: int, least: int = 10_000) -> DataFrame:
    """The rows of counts (one a key) whose n exceeds both least and 1 / HOT of rows: fewer than HOT, as all n sum to rows at most."""
    return counts.where(F.col(n) > max(least, rows // HOT))


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, salt: list[str], parts: int = PARTS) -> DataFrame:
    """rows joined to facts, which have one row a key; rows of a hot key are dealt by the columns salt, so that no task gathers them.

    hot has the keys' columns alone and fewer than HOT rows; only these keys' facts are repeated. Null keys meet nothing.
    """
    mark = F.broadcast(hot.select(*keys, F.lit(parts).alias("_parts")))
    n = F.coalesce("_parts", F.lit(1)).cast("long")
    r = rows.join(mark, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt), n)).drop("_parts")
    f = facts.join(mark, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_parts")
    return r.join(f, [*keys, "_salt"]).drop("_salt")


def id_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def bounded_labels(documents: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column) -> DataFrame:
    """At most per_class ids of each label value 0 and 1, the lowest by hash: (doc_id, label, n), n characters.

    Only ids of documents with a text are chosen. Null ids and other label values are left out; an id
    with both values counts as 1; of repeated ids the longest text counts.
    """
    slim = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("label"))
    )
    there = documents.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n")).join(slim, "doc_id")
    there = there.groupBy("doc_id", "label").agg(F.max("n").alias("n"))
    parts = [
        there.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
        for k in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def longest_fit(sizes: list[int], room: int) -> int:
    """The largest length so that sizes, each cut to it, add up to at most room."""
    for i, n in enumerate(found := sorted(sizes)):
        if n * (len(found) - i) > room:
            return room // (len(found) - i)
        room -= n
    return max(sizes, default=0)


def whole_sentences(text: str, size: int) -> str:
    """The start of a text, of at most size characters, up to the end of a sentence or else of a word."""
    if len(text) <= size:
        return text
    start = text[:size]
    end = max(start.rfind(c) for c in ".!?\n") + 1
    return start[:end] if end else start[: max(start.rfind(c) for c in WORD_SPACE)] if re.search(r"\s", start) else start


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, learn: Column
) -> tuple[DataFrame, int]:
    """A bounded training sample (doc_id, label, text), and the length at which texts are to be cut.

    All chosen texts together have at most 2 * per_class * max_chars characters. That is the only
    bound: while they keep it all are whole; else the longest are cut, never below max_chars. Null texts
    are not learnt from (they are scored all the same). The ids are at most 2 * per_class rows, so they
    are collected and broadcast.
    """
    chosen = bounded_labels(documents, labels, label, per_class, learn).collect()
    size = longest_fit([r.n for r in chosen], 2 * per_class * max_chars)
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = documents.sparkSession.createDataFrame([(r.doc_id, r.label) for r in chosen], f"doc_id {kind}, label int")
    rows = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(ids), "doc_id")
        .select("doc_id", "label", F.substring("text", 1, size + 1).alias("text"))
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
    return rows, size


def blocks(data: bytes, size: int, overlap: int) -> Iterator[bytes]:
    """Pieces of at most size bytes that cover data, each repeating overlap bytes of the one before."""
    if len(data) <= size:
        yield data
        return
    for start in range(0, len(data) - overlap, size - overlap):
        yield data[start : start + size]
