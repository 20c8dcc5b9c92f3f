"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is a logistic function of hashed word and
word-start features, and the document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights
are trained from document labels alone; offending sentences are then those with a high probability.
Learning, scoring and locating cut sentences alike: one ends after a token, set off by white space, that holds one of
``.!?``, and at a line's end; texts of over ``PIECE`` characters are cut at white space besides.
A sentence without any weighted feature counts as probability 0, so that a document's length alone makes it no more toxic.

Learning uses a bounded sample: at most ``PER_CLASS`` documents of either label, taken by hash from the rows
that may be learnt from, with ``MAX_CHARS`` characters each on average at most (only beyond that the longest
are cut, see ``common``). Features are hashed in Spark's tasks, so the driver holds no texts. Every text is
scored whole.

Defined results: null and empty texts are one empty sentence and score 0;
with no labels of both kinds every score is the share of toxic labels (0 with none at all); repeated
rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, cut, id_fold, labelled_sample, whole_sentences

FEATURES = 1 << 18
PER_CLASS = 2000
MAX_CHARS = 20_000
THRESHOLD = 0.7
PIECE = 1 << 20
#: Features of documents that go through a step of learning at once.
BLOCK = 1 << 19
#: Smaller weights are dropped.
LEAST_WEIGHT = 0.4
#: Words kept by a worker; beyond, the memory starts anew.
MEMORY = 200_000
#: Lengths of the word starts that are features beside the word itself.
STARTS = (4, 5, 6)
CORE = re.compile(r"[^\W_]+")
ENDS = re.compile(r"[.!?]")
TOKEN = re.compile(r"\n|\S+")


def feature_names(token: str) -> list[tuple[int, str]]:
    """A token's words as (0, word) and their first n letters as (n, letters)."""
    out = []
    for word in CORE.findall(token):
        out.append((0, word))
        out += [(n, word[:n]) for n in STARTS if len(word) >= n]
    return out


def cell_of(name: tuple[int, str]) -> int:
    """The cell that a feature is hashed to while learning."""
    return crc32(f"{name[0]} {name[1]}".encode("utf-8", "replace")) % FEATURES


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text at white space into pieces of about size characters."""
    start = 0
    while len(text) - start > size:
        found = re.compile(r"\s").search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def tokens(text: str) -> list[str]:
    """Lower-cased words by white space; a line's end is a token of its own that ends a sentence."""
    return text.lower().replace("\n", " . ").split()


class ToxicityModel:
    """Positive weights by feature and a bias; scores are noisy-or over sentences."""

    def __init__(self, weights: dict[tuple[int, str], float], bias: float, constant: float | None = None) -> None:
        self.weights, self.bias, self.constant = weights, bias, constant
        self.by_length = [(n, {w: x for (k, w), x in weights.items() if k == n}) for n in (0, *STARTS)]
        self._forget()

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "constant": self.constant}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _forget(self) -> None:
        model = self

        class Memory(dict):
            """token -> number of the token, for tokens met so far."""

            def __missing__(self, token: str) -> int:
                self[token] = n = len(self)
                if total := model.token_sum(token):
                    model.sums[n] = total
                if not token.isalpha() and ENDS.search(token):
                    model.ends[n] = True
                return n

        room = MEMORY + 2 * PIECE + 2
        self.sums, self.ends, self.memory = np.zeros(room), np.zeros(room, bool), Memory()

    def token_sum(self, token: str) -> float:
        """Sum of a token's weights."""
        total = 0.0
        for word in (token,) if token.isalpha() else CORE.findall(token):
            for n, table in self.by_length:
                total += table.get(word[:n] if n else word, 0.0)
        return total

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """Probability of each sentence that has a word, in order; of one empty sentence at the end.

        A word counts once in a sentence, however often it is repeated; a sentence without weight scores 0.
        """
        logits = []
        for piece in pieces(text or ""):
            words = tokens(piece)
            if not words:
                continue
            if len(self.memory) > MEMORY:
                self._forget()
            ids = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))
            ends = self.ends[ids]
            sentence = np.cumsum(ends) - ends
            scored = np.nonzero(self.sums[ids])[0]
            met = np.unique(sentence[scored] * len(self.sums) + ids[scored])
            logits.append(np.bincount(met // len(self.sums), self.sums[met % len(self.sums)], sentence[-1] + 1))
        sums = np.concatenate([*logits, np.zeros(1)])
        return np.where(sums > 0, 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30))), 0.0)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return max(0.0, float(-np.expm1(np.log1p(-np.minimum(self.sentence_scores(text), 1 - 1e-12)).sum())))

    def offending(self, text: str | None, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences of at least threshold, as character offsets: those that score() multiplies."""
        if not text or self.constant is not None:
            return []
        spans = list(sentence_spans(text))
        scores = self.sentence_scores(text)[: len(spans)]
        return [(*spans[k], float(scores[k])) for k in np.nonzero(scores >= threshold)[0] if scores[k] > 0]


def sentence_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence, in the order of sentence_scores(); a line's end after a sentence's end is an empty one."""
    at = 0
    for piece in pieces(text):
        start = end = None
        for m in TOKEN.finditer(piece):
            line = m[0] == "\n"
            if start is None:
                start = end = at + m.start()
            if not line:
                end = at + m.end()
            if line or ENDS.search(m[0]):
                yield start, end
                start = None
        if start is not None:
            yield start, end
        at += len(piece)


def sentence_cells(text: str, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a text's sentences, each once in a sentence, and their number in each sentence; seen holds those of tokens."""
    cells, sizes = [], []

    def close(sentence: set[str]) -> None:
        found = []
        for token in sentence:
            own = seen.get(token)
            if own is None:
                own = seen.setdefault(token, np.array([cell_of(x) for x in feature_names(token)], np.int32))
            found.append(own)
        if found and len(met := np.unique(np.concatenate(found))):
            cells.append(met)
            sizes.append(len(met))

    sentence: set[str] = set()
    for token in tokens(text):
        sentence.add(token)
        if ENDS.search(token):
            close(sentence)
            sentence = set()
    close(sentence)
    if len(seen) > MEMORY:
        seen.clear()
    return np.concatenate(cells) if cells else np.zeros(0, np.int32), np.array(sizes, np.int32)


def noisy_or_gradient(
    bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: np.ndarray, w: np.ndarray, bias: float
) -> tuple[float, np.ndarray, float]:
    """The log-likelihood of the labels y of bags, weighted by share, and its gradient by weights and bias."""
    cell = np.concatenate([c for c, _ in bags])
    own = np.repeat(np.arange(len(bags)), [len(n) for _, n in bags])
    sent = np.repeat(np.arange(len(own)), np.concatenate([n for _, n in bags]))
    sums = np.bincount(sent, w[cell], len(own))
    p = np.where(sums > 0, 1 / (1 + np.exp(-np.clip(sums + bias, -30, 30))), 0.0)
    miss = np.exp(np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)))
    likelihood = float((share * np.log(np.maximum(np.where(y == 1, 1 - miss, miss), 1e-300))).sum())
    step = (np.where(y == 1, miss / np.maximum(1 - miss, 1e-9), -1.0) * share)[own] * p
    return likelihood, np.bincount(cell, step[sent], len(w)), float(step.sum())


def learn_weights(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 30, rate: float = 0.2, decay: float = 2e-6
) -> tuple[np.ndarray, float]:
    """Weight of each cell, and the bias: maximise the noisy-or likelihood of the labels by full-batch Adagrad.

    Weights start from the documents' log-odds of each feature, less 2.5, and stay at 0 or above, so that a
    long sentence of harmless words can't outweigh a toxic one. Labels are of both kinds.
    """
    y = np.array(labels)
    docs_with = np.zeros((2, FEATURES))
    for (cells, _), k in zip(bags, labels, strict=True):
        docs_with[k, np.unique(cells)] += 1
    odds = np.log((docs_with[1] + 1) / (y.sum() + 2)) - np.log((docs_with[0] + 1) / ((1 - y).sum() + 2))
    w, bias = np.maximum(odds - 2.5, 0.0), -6.0
    g2, b2 = np.full(FEATURES, 1e-5), 1e-5
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ends = np.cumsum([len(cells) for cells, _ in bags])
    parts = np.split(np.arange(len(bags)), np.nonzero(np.diff(ends // BLOCK))[0] + 1)
    for _ in range(rounds):
        grad, up = -decay * w, 0.0
        for part in parts:
            _, by_weight, by_bias = noisy_or_gradient([bags[i] for i in part], y[part], balance[part] / len(y), w, bias)
            grad += by_weight
            up += by_bias
        g2 += grad**2
        b2 += up**2
        w = np.maximum(w + rate * grad / np.sqrt(g2), 0.0)
        bias += 0.2 * rate * up / np.sqrt(b2)
    return w, float(bias)


def constant_model(labels: list[int]) -> ToxicityModel | None:
    """What is learnt from labels of one kind, or none."""
    if not labels or min(labels) == max(labels):
        return ToxicityModel({}, 0.0, float(labels[0]) if labels else 0.0)
    return None


def names_in(texts: list[str]) -> set[tuple[int, str]]:
    return {name for token in {t for text in texts for t in tokens(text)} for name in feature_names(token)}


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """The model of texts at hand."""
    if (only := constant_model(labels)) is not None:
        return only
    seen: dict[str, np.ndarray] = {}
    w, bias = learn_weights([sentence_cells(text, seen) for text in texts], labels)
    return ToxicityModel({name: float(w[c]) for name in names_in(texts) if w[c := cell_of(name)] > LEAST_WEIGHT}, bias)


def _featuriser(size: int):
    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            bags = [sentence_cells(whole_sentences(t, size), seen) for t in batch["text"]]
            yield batch[["doc_id", "label"]].assign(cells=[c.tobytes() for c, _ in bags], sizes=[n.tobytes() for _, n in bags])

    return featurise


def _namer(size: int, kept: np.ndarray):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for x in names_in([whole_sentences(t, size) for t in batch["text"]]) if kept[cell_of(x)]]
            yield pd.DataFrame({"letters": np.array([n for n, _ in found], np.int32), "word": np.array([w for _, w in found], object)}, dtype=object)

    return find


def train(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit to the bounded sample of labelled documents for which learn, over doc_id, holds."""
    bounded_batches(documents.sparkSession)
    sample, size = labelled_sample(documents, labels, "toxic", per_class, MAX_CHARS, learn)
    sample = cut(sample)
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.mapInPandas(_featuriser(size), f"doc_id {kind}, label int, cells binary, sizes binary").collect(), key=lambda r: r.doc_id)
    y = [int(r.label) for r in rows]
    if (only := constant_model(y)) is not None:
        return only
    w, bias = learn_weights([(np.frombuffer(r.cells, np.int32), np.frombuffer(r.sizes, np.int32)) for r in rows], y)
    del rows
    names = sample.mapInPandas(_namer(size, w > LEAST_WEIGHT), "letters int, word string").distinct().collect()
    return ToxicityModel({(r.letters, r.word): float(w[cell_of((r.letters, r.word))]) for r in names}, bias)


def scorer(documents: DataFrame, model: ToxicityModel):
    """A column function: text -> score double."""
    bounded_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.score(t) for t in texts.tolist()], dtype=float)

    return score


def locator(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5):
    """A column function: text -> array of the offending sentences' offsets and probabilities."""
    bounded_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("array<struct<start:int,end:int,probability:double>>")
    def locate(texts: pd.Series) -> pd.Series:
        found = [held.value.offending(t, threshold) for t in texts.tolist()]
        return pd.Series([[{"start": a, "end": b, "probability": p} for a, b, p in x] for x in found], dtype=object)

    return locate


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from folds other than 1 of 3."""
    slim = documents.select("doc_id", "text")
    held_out = id_fold(F.col("doc_id"), 3) == 1
    score = scorer(documents, train(slim, labels, ~held_out))
    return slim.select("doc_id", held_out.alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def offending_sentences(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, probability of every offending sentence."""
    slim = documents.select("doc_id", "text")
    locate = locator(documents, train(slim, labels, id_fold(F.col("doc_id"), 3) != 1), threshold)
    found = slim.withColumn("s", F.explode(locate("text")))
    return found.select(
        "doc_id", "s.start", "s.end",
        F.expr("substring(text, s.start + 1, s.end - s.start)").alias("sentence"), "s.probability",
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below threshold, with their own columns."""
    model = train(documents.select("doc_id", "text"), labels, id_fold(F.col("doc_id"), 3) != 1)
    mark = "_tessera_toxic"
    return documents.withColumn(mark, scorer(documents, model)("text")).where(F.col(mark) < threshold).drop(mark)
