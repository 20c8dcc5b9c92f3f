"""Language ID: multinomial naive Bayes over hashed character n-grams.

The n-grams (1 to 3 characters, code points of the lower-cased text) are hashed to ``BUCKETS`` cells. Counts are
summed in Spark over a bounded, hash-chosen sample of labelled documents, about ``PER_LANG`` texts of every
language; one row a language comes to the driver. The log-probability matrix (buckets x languages) is
broadcast and documents are scored in numpy as sparse rows, batch by batch. All languages are learnt; more
than ``MOST_LANGS``, for which the matrix would outgrow a worker, are an error.

The score is the posterior of the language chosen, evidence and prior weighing at most as much as those of
``EVIDENCE`` n-grams; choice and score come from the same sums.

Defined results: null text or a text without a letter gives ``und`` with score 0; empty input gives
no rows; repeated rows give repeated results; ties go to the language that sorts first; with nothing
to learn from every text is ``und``. Extra columns are ignored. Very long texts are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, id_fold, unit_hash

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Texts of one language that are learnt from, in expectation.
PER_LANG = 3000
#: Languages whose matrix (256 KB each) still fits a worker.
MOST_LANGS = 1000
BLOCK = 1 << 20
#: N-grams of a block from which its distinct ones are counted first; n-grams held at once; numbers of a slice of n-grams by languages.
DENSE, HELD, SLICE = BUCKETS // 4, 1 << 18, 1 << 20
#: A text's evidence counts as that of so many n-grams at most, so that scores differ from 0 and 1.
EVIDENCE = 60.0
LETTER = regex.compile(r"\p{L}")


def code_points(text: str) -> Iterator[np.ndarray]:
    """The lower-cased text's code points in blocks that overlap by the longest n-gram less one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    step = BLOCK - max(ORDERS) + 1
    for start in range(0, max(1, len(points) - max(ORDERS) + 1), step):
        yield points[start : start + BLOCK]


def ngram_cells(points: np.ndarray, first: bool = True, buckets: int = BUCKETS) -> np.ndarray:
    """The cell of every n-gram of a block, as int32; n-grams that lie whole in the overlap with the block before count there alone."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    out, h = [], np.zeros(len(points) + 1, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = (h[:-1] ^ points[n - 1 :]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            out.append((((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift)[0 if first else max(ORDERS) - n :])
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            into = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for k, block in enumerate(code_points(text)):
                into += np.bincount(ngram_cells(block, k == 0), minlength=BUCKETS)
    for lang, counts in totals.items():
        cells = np.nonzero(counts)[0]
        yield pd.DataFrame({"lang": lang, "cell": cells.astype(np.int32), "n": counts[cells]})


def _log_row(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One language's log-probabilities from its counts, at most one a bucket."""
    table = np.full(BUCKETS, 0.5)
    np.add.at(table, rows["cell"].to_numpy(int), rows["n"].to_numpy(float))
    return pd.DataFrame({"lang": [key[0]], "logs": [np.log(table / table.sum()).astype("<f4").tobytes()]})


class LanguageModel:
    """Languages and the matrix of log-probabilities, buckets x languages."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.log_prob, self.prior = langs, log_prob, prior

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        sums, grams = np.zeros((n, max(1, len(self.langs)))), np.zeros(n)
        known = [bool(self.langs) and t is not None and LETTER.search(t) is not None for t in texts]
        owners: list[int] = []
        parts: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            """Add up what each text's cells say, each times its count, in slices whose products with all languages are bounded."""
            nonlocal held
            own = np.repeat(np.array(owners), [len(p) for p in parts])
            cells, counts = np.concatenate(parts), np.concatenate(times)
            step = max(1, SLICE // max(1, len(self.langs)))
            for at in range(0, len(cells), step):
                mine = own[at : at + step]
                starts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                rows = self.log_prob[cells[at : at + step]] * counts[at : at + step, None]
                np.add.at(sums, mine[starts], np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
            owners.clear(), parts.clear(), times.clear()
            held = 0

        for i, text in enumerate(texts):
            if not known[i]:
                continue
            for k, block in enumerate(code_points(text)):
                cells = ngram_cells(block, k == 0)
                grams[i] += len(cells)
                if len(cells) >= DENSE:
                    counts = np.bincount(cells, minlength=BUCKETS)
                    cells = np.flatnonzero(counts)
                    counts = counts[cells]
                else:
                    counts = np.ones(len(cells))
                if len(cells):
                    owners.append(i), parts.append(cells), times.append(counts)
                    held += len(cells)
                if held >= HELD:
                    flush()
        if parts:
            flush()
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        z = (sums + self.prior) * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None]
        best = z.argmax(axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        share = z[np.arange(n), best] / z.sum(axis=1)
        ok = np.array(known, bool)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(ok, share, 0.0)


def train(documents: DataFrame, learn: Column, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> LanguageModel:
    """Learn from documents (doc_id, text, lang) for which learn holds; about per_lang texts of each language."""
    bounded_batches(documents.sparkSession)
    rows = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"over {most_langs} values of lang: their model would not fit a worker")
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    sample = rows.where(unit_hash(F.col("doc_id"), F.lit(29)) < share[F.col("lang")])
    logs = (
        sample.select("lang", "text")
        .repartition(max(16, 4 * len(sizes)), "lang", F.pmod(F.xxhash64("text"), F.lit(16)))
        .mapInPandas(_count, "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .applyInPandas(_log_row, "lang string, logs binary")
        .collect()
    )
    logs.sort(key=lambda r: r["lang"])
    langs = [r["lang"] for r in logs]
    table = np.zeros((BUCKETS, max(1, len(langs))), np.float32)
    for i, r in enumerate(logs):
        table[:, i] = np.frombuffer(r["logs"], "<f4")
    return LanguageModel(langs, table, np.log([sizes[k] for k in langs] or [1]))


def predictor(documents: DataFrame, model: LanguageModel):
    """A column function: text -> struct<lang_pred string, score double>."""
    bounded_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = held.value.score(texts.tolist())
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": scores})

    return predict


def identify(documents: DataFrame, learn_parts: int = 5) -> DataFrame:
    """Train on the rows whose id fold is not 0 and predict every row: doc_id, held_out, lang_pred, score."""
    slim = documents.select("doc_id", "text", "lang")
    held_out = id_fold(F.col("doc_id"), learn_parts) == 0
    predict = predictor(documents, train(slim, ~held_out))
    return slim.select("doc_id", held_out.alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def keep_identified(documents: DataFrame, min_score: float = 0.3, learn_parts: int = 5) -> DataFrame:
    """The documents whose language is known with at least min_score, with their own columns."""
    held_out = id_fold(F.col("doc_id"), learn_parts) == 0
    predict = predictor(documents, train(documents.select("doc_id", "text", "lang"), ~held_out))
    mark = "_tessera_language"
    return (
        documents.withColumn(mark, predict("text"))
        .where((F.col(mark)["lang_pred"] != "und") & (F.col(mark)["score"] >= min_score))
        .drop(mark)
    )
