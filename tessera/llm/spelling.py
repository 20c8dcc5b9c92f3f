"""Spelling variants by symmetric deletion: words that share a deletion are near, a word's form is its most frequent near word.

Every word emits itself and its deletions under keys of what is left of the word and, for replacements, the place:

* two words of one length with equal rests after deleting the same place differ exactly there. All members of such a key are near
  each other, so its facts (how many, the two most frequent) are aggregated first, and an equi-join of members to facts gives
  each member its count and best other member. No pairs are made, and a key has as many members as there are letters, at most.
* a word whose deletion is another word differs from it by that letter. An equi-join of each word's distinct deletions to the words
  themselves gives exactly these links, each once, for both ends.

Every join's result is verified by the words' texts (equal without the letters at the places named, so exactly one edit apart), counts and best near words are aggregated per
word, and roots are found by joining forms to forms until none has a further form; a form is at least ``RATIO`` times as frequent as its
word, so that takes as many rounds as the largest count has digits, at most.

Words travel as numbers in code-point order, their texts only to be verified and returned. Keys are 124 bits: two polynomials over the
letters, modulo four primes, taken for all deletions of a word at once, so that a word of a million letters costs a million keys and not
as many copies of itself. Texts that differ under one key would be noticed and end the run.

Defined results: null texts and documents without runs have no words; a null doc_id counts as empty text in the hash; rows with one id are
documents of their own; ties go to the smallest word in code-point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_facts

#: Letters of a run, least code points of a word, least occurrences, how much more frequent a form is, and which hashes lose a letter.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_N, RATIO, DAMAGED = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Primes below 2 ** 31, so that products of two residues fit 64 bits, and a base of the polynomials for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (911382323, 972663749, 1000003939, 735632797)
#: Letters of a batch for which keys are made at once.
LETTERS_AT_ONCE = 1 << 20


def runs(documents: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """word of each occurrence that counts: long runs, in lower case, without a letter where the hash says so."""
    # a possessive match takes a run whole or not at all; shorter runs can't become words
    found = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0)))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), found.alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.left("run", at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DAMAGED == 0, shorter).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least)


def counted(documents: DataFrame, least: int = LEAST_LETTERS, least_n: int = LEAST_N) -> DataFrame:
    """id, word, n: words that occur often enough, with ids in code-point order."""
    often = cut(runs(documents, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n))
    # bytes of UTF-8 sort as code points; ids of a written table stay as they are
    return cut(often.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))


@functools.cache
def _powers(prime: int, base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1), by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
    return out[:size]


def _residues(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Modulo the k-th prime, of concatenated words: each word's polynomial, and that of what is left without each letter."""
    prime, base = PRIMES[k], BASES[k]
    p = np.uint64(prime)
    size = 1 << int(lengths.max() - 1).bit_length() if lengths.max() > 1 else 1
    inside = np.arange(len(letters), dtype=np.int64) - np.repeat(starts, lengths)
    terms = letters.astype(np.uint64) * _powers(prime, base, size)[inside] % p
    upto = np.concatenate([[np.uint64(0)], np.cumsum(terms)])  # under 2 ** 31 each: no overflow in a batch
    first, last = np.repeat(upto[starts], lengths), np.repeat(upto[starts + lengths], lengths)
    at = np.arange(len(letters))
    before, after = (upto[at] - first) % p, (last - upto[at + 1]) % p
    # letters behind the deleted one move down by one place
    return (upto[starts + lengths] - upto[starts]) % p, (before + after * np.uint64(pow(base, -1, prime)) % p) % p


def _keys(words: list[str]) -> pd.DataFrame:
    """For each word: own key (two numbers), those of its deletions, and which deletions are distinct."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    whole, rests = zip(*[_residues(letters, starts, lengths, k) for k in range(4)], strict=True)
    pair = lambda x, y: (x << np.uint64(31) | y).view(np.int64)
    # deleting any letter of a repetition leaves the same: the first stands for all
    distinct = np.ones(len(letters), bool)
    distinct[1:] = letters[1:] != letters[:-1]
    distinct[starts] = True
    cuts = starts[1:]
    split = lambda x: np.split(x, cuts)
    return pd.DataFrame({
        "own1": pair(whole[0], whole[1]), "own2": pair(whole[2], whole[3]),
        "rest1": split(pair(rests[0], rests[1])), "rest2": split(pair(rests[2], rests[3])), "first": split(distinct),
    })


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        start, sizes = 0, np.cumsum(batch["word"].str.len().to_numpy())
        while start < len(batch):
            # whole words, as many as fit, one at least
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + LETTERS_AT_ONCE, "right")))
            part = batch.iloc[start:stop].reset_index(drop=True)
            yield pd.concat([part[["id", "n"]], _keys(part["word"].tolist())], axis=1)
            start = stop


_EMITTED = "id long, n long, own1 long, own2 long, rest1 array<long>, rest2 array<long>, first array<boolean>"
_KEY = ["k1", "k2", "place"]


def emitted(words: DataFrame) -> DataFrame:
    """id, n and arrays of the keys under which a word meets others."""
    return words.select("id", "word", "n").mapInPandas(_emit, _EMITTED)


def _rank(n: str, key: str) -> Column:
    """Greater for more occurrences, of equal ones for the smaller word."""
    return F.struct(F.col(n).alias("n"), (-F.col(key)).alias("minus"))


def _replaced(keys: DataFrame) -> DataFrame:
    """id, place, mate, mate_place, mate_n, more: for each member of a key with others, the best other and how many there are."""
    at = F.posexplode(F.arrays_zip("rest1", "rest2")).alias("place", "rest")
    members = keys.select("id", "n", at).select("id", "n", "place", F.col("rest.rest1").alias("k1"), F.col("rest.rest2").alias("k2"))
    # words of unequal lengths leave unequal rests, so they never share a key
    members = members.repartition(*_KEY)
    # at most one member for each letter
    ranked = F.sort_array(F.collect_list(_rank("n", "id")), False)
    facts = members.groupBy(*_KEY).agg(F.slice(ranked, 1, 2).alias("two"), (F.count(F.lit(1)) - 1).alias("more")).where("more > 0")
    joined = members.join(facts, _KEY)
    best = F.when(F.col("two")[0]["minus"] == -F.col("id"), F.col("two")[1]).otherwise(F.col("two")[0])
    return joined.select("id", "place", (-best["minus"]).alias("mate"), F.col("place").alias("mate_place"), best["n"].alias("mate_n"), "more")


def _deleted(keys: DataFrame) -> DataFrame:
    """id, place, mate, mate_place, mate_n, more (1) for both ends of every link between a word and one of its deletions; the shorter's place is null."""
    rest = F.posexplode(F.arrays_zip("rest1", "rest2", "first")).alias("place", "rest")
    longer = keys.select("id", "n", rest).where("rest.first").select("id", "n", "place", F.col("rest.rest1").alias("k1"), F.col("rest.rest2").alias("k2"))
    shorter = keys.select(F.col("id").alias("mate"), F.col("n").alias("mate_n"), F.col("own1").alias("k1"), F.col("own2").alias("k2"))
    links = longer.join(shorter, ["k1", "k2"])
    ends = F.explode(F.array(
        F.struct("id", "place", "mate", F.lit(None).cast("int").alias("mate_place"), "mate_n"),
        F.struct(F.col("mate").alias("id"), F.lit(None).cast("int").alias("place"), F.col("id").alias("mate"), F.col("place").alias("mate_place"), F.col("n").alias("mate_n")),
    )).alias("e")
    return links.select(ends).select("e.*", F.lit(1).cast("long").alias("more"))


def near(words: DataFrame) -> DataFrame:
    """id, n_near, form, form_n (of the best near word) of every word that has near words."""
    keys = cut(emitted(words))
    links = _replaced(keys).unionByName(_deleted(keys))
    texts = words.select("id", "word")
    rows = links.join(texts, "id").join(texts.select(F.col("id").alias("mate"), F.col("word").alias("mate_word")), "mate")
    rest = lambda word, place: F.coalesce(F.concat(F.left(word, F.col(place)), F.substr(word, F.col(place) + 2)), F.col(word))
    one_apart = (rest("word", "place") == rest("mate_word", "mate_place")) & (F.col("word") != F.col("mate_word"))
    sure = F.when(one_apart, F.col("more")).otherwise(
        F.raise_error(F.concat(F.lit("one key for two different rests: "), "word", F.lit(", "), "mate_word")).cast("long")
    )
    best = rows.groupBy("id").agg(F.sum(sure).alias("n_near"), F.max(_rank("mate_n", "mate")).alias("best"))
    return best.select("id", "n_near", (-F.col("best.minus")).alias("form"), F.col("best.n").alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root of every word that has a form; forms has id and form, and no circle."""
    at = cut(forms.select("id", F.col("form").alias("root"), F.lit(1).alias("step")))
    steps, onward = [at], forms.select(F.col("id").alias("root"), F.col("form").alias("next"))
    while n := at.count():
        # words of one form are dealt out where there are very many
        hot = hot_keys(at.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "n", n).select("root")
        at = cut(join_facts(at, onward, ["root"], hot, ["id"]).select("id", F.col("next").alias("root"), (F.col("step") + 1).alias("step")))
        steps.append(at)
    every = functools.reduce(DataFrame.unionByName, steps)
    return every.groupBy("id").agg(F.max_by("root", "step").alias("root"))


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = counted(documents)
    close = cut(near(words))
    chosen = words.join(close, "id", "left").withColumn("has", F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False)))
    chosen = cut(chosen.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("form")).alias("form_id"), F.when(F.col("has"), F.col("form_n")).alias("form_n"),
    ))
    linked = chosen.where("form_id IS NOT NULL")
    ends = roots(linked.select("id", F.col("form_id").alias("form")))
    text = lambda name: words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
    named = linked.join(ends.withColumnRenamed("root", "root_id"), "id").join(text("form"), "form_id").join(text("root"), "root_id")
    out = ["word", "form", "root", "n", "n_near", "form_n"]
    plain = chosen.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return named.select(*out).unionByName(plain.select(*out))


def oracle_sql() -> str:
    """The same rows in SQL: CRC-32 by its table over the bytes of UTF-8, near words by deletions and places, roots by recursion."""
    return f"""
    WITH RECURSIVE crc_bits(i, k, x) AS (
      SELECT i, 0, i::BIGINT FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc_bits WHERE k < 8),
    crc_table AS (SELECT list(x ORDER BY i) AS crc FROM crc_bits WHERE k = 8),
    found AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    lowered AS (SELECT doc, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times FROM found WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
    coded AS (SELECT *, list_transform(range(1, length(run) + 1), lambda i: unicode(substr(run, i, 1))) AS points FROM lowered),
    bytes AS (SELECT *, list_concat(list_transform(range(1, length(doc) + 2), lambda i: ascii(substr(doc || ':', i, 1))::BIGINT),
      flatten(list_transform(points, lambda c: CASE WHEN c < 128 THEN [c::BIGINT] ELSE [(192 + (c >> 6))::BIGINT, (128 + (c & 63))::BIGINT] END))) AS b FROM coded),
    hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
    damaged AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
    words AS (SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {LEAST_N}),
    dels AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM words, unnest(range(length(word)::INT)) u(p)),
    links AS (
      SELECT a.word, b.word AS mate, b.n AS mate_n FROM dels a JOIN dels b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
      UNION SELECT d.word, w.word, w.n FROM dels d JOIN words w ON d.rest = w.word
      UNION SELECT w.word, d.word, d.n FROM dels d JOIN words w ON d.rest = w.word),
    best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, mate, mate_n FROM links
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY mate_n DESC, mate) = 1),
    chosen AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN mate_n >= {RATIO} * w.n THEN mate END AS form,
      CASE WHEN mate_n >= {RATIO} * w.n THEN mate_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
    chain(word, last) AS (SELECT word, word FROM chosen UNION ALL SELECT k.word, c.form FROM chain k JOIN chosen c ON c.word = k.last WHERE c.form IS NOT NULL),
    ends AS (SELECT k.word, k.last AS root FROM chain k JOIN chosen c ON c.word = k.last WHERE c.form IS NULL)
    SELECT c.word, c.form, e.root, c.n, c.n_near::BIGINT AS n_near, c.form_n FROM chosen c JOIN ends e ON e.word = c.word"""
