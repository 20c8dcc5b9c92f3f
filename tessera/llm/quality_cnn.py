"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``WIDTH - 1`` and cover the
whole document. ``FILTERS`` learned filters over ``WIDTH`` bytes (a weight for every byte value at every
place, that is, a convolution of one-hot bytes) are rectified and max-pooled per chunk; the mean and the
maximum of the chunks' vectors enter one logistic unit.

Learning uses at most ``PER_CLASS`` documents of either label, taken by hash, with ``MAX_CHARS`` characters
each on average at most (only beyond that the longest are cut, see ``common``), and in each round at most ``TRAIN_CHUNKS`` chunks of a document. Every document is scored
whole.

Defined results: null and empty texts are one chunk of zero bytes; with no labels of both kinds every
score is the share of label 1 (0 with none at all); repeated rows give repeated results; extra columns
are ignored; very long texts are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_fold, labelled_sample, whole_sentences

WIDTH, FILTERS, CHUNK = 6, 16, 512
STEP = CHUNK - WIDTH + 1
PER_CLASS = 1500
MAX_CHARS = 20_000
TRAIN_CHUNKS = 6
#: Chunks that go through the filters at once.
BLOCK = 256


def chunked(data: bytes) -> np.ndarray:
    """Overlapping chunks as a matrix of bytes; the last one is filled up with zero bytes."""
    n = max(1, -(-max(0, len(data) - WIDTH + 1) // STEP))
    flat = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


class ByteNet:
    """Filters (WIDTH x 256 x FILTERS), their biases, and the output weights for mean and maximum."""

    def __init__(self, tables: np.ndarray, offset: np.ndarray, out: np.ndarray, bias: float, constant: float | None = None) -> None:
        self.tables, self.offset, self.out, self.bias, self.constant = tables, offset, out, bias, constant

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Max-pooled filter responses of each chunk, and the places of the maxima if asked for."""
        z = self.tables[0][chunks[:, :STEP]]
        for j in range(1, WIDTH):
            z += self.tables[j][chunks[:, j : j + STEP]]
        if places:
            at = z.argmax(axis=1)
            return np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.offset, 0), at
        return np.maximum(z.max(axis=1) + self.offset, 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text; chunks of several texts go through the filters together."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        n = len(texts)
        total, most, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
        waiting: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not waiting:
                return
            rows, own = np.concatenate(waiting), np.concatenate(owner)
            got = np.concatenate([self.pooled(rows[a : a + BLOCK]) for a in range(0, len(rows), BLOCK)])
            starts = np.concatenate(([0], np.nonzero(np.diff(own))[0] + 1))
            who = own[starts]
            total[who] += np.add.reduceat(got, starts)
            most[who] = np.maximum(most[who], np.maximum.reduceat(got, starts))
            count[who] += np.diff(np.append(starts, len(own)))
            waiting.clear(), owner.clear()
            held = 0

        for i, text in enumerate(texts):
            rows = chunked((text or "").encode("utf-8", "replace"))
            for a in range(0, len(rows), 4 * BLOCK):
                part = rows[a : a + 4 * BLOCK]
                waiting.append(part), owner.append(np.full(len(part), i))
                held += len(part)
                if held >= 4 * BLOCK:
                    flush()
        flush()
        z = np.concatenate([total / np.maximum(count, 1)[:, None], most], 1) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def loss_gradient(net: ByteNet, rows: np.ndarray, sizes: np.ndarray, y: np.ndarray, share: np.ndarray):
    """The logistic loss of documents, weighted by share, and its gradients by tables, offset, out and bias.

    rows are the chunks of all documents one after another, sizes their numbers. Gradients flow through the maxima alone.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    own = np.repeat(np.arange(len(sizes)), sizes)
    got, at = net.pooled(rows, True)
    mean, most = np.add.reduceat(got, starts) / sizes[:, None], np.maximum.reduceat(got, starts)
    top = np.concatenate([mean, most], 1)
    p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -30, 30)))
    loss = -float((share * np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-30))).sum())
    d = ((p - y) * share).astype(net.tables.dtype)
    back = d[:, None] * net.out
    place = np.arange(len(rows))[:, None]
    first = np.minimum.reduceat(np.where(got >= most[own], place, len(rows)), starts)  # of equal maxima the first chunk's counts
    gate = (got > 0) * (back[own, :FILTERS] / sizes[own][:, None] + back[own, FILTERS:] * (place == first[own]))
    grad = np.zeros(net.tables.size, np.float64)
    chunk, filt = np.nonzero(gate)
    for j in range(WIDTH):
        cell = (j * 256 + rows[chunk, at[chunk, filt] + j].astype(np.int64)) * FILTERS + filt
        grad += np.bincount(cell, gate[chunk, filt], net.tables.size)
    return loss, grad.reshape(net.tables.shape), gate.sum(0), d @ top, float(d.sum())


def fit(texts: list[str], labels: list[int], rounds: int = 14, batch: int = 32, seed: int = 5) -> ByteNet:
    """Minimise the logistic loss by Adam."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    net = ByteNet(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    docs = [chunked(t.encode("utf-8", "replace")) for t in texts]
    learn_t, learn_o, learn_w, learn_b = _Adam(net.tables.shape, 0.01), _Adam((FILTERS,), 0.01), _Adam((2 * FILTERS,), 0.01), _Adam((1,), 0.01)
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            ids = order[a : a + batch]
            picked = [d if len(d) <= TRAIN_CHUNKS else d[np.sort(rng.choice(len(d), TRAIN_CHUNKS, False))] for d in (docs[i] for i in ids)]
            _, tables, offset, out, bias = loss_gradient(net, np.concatenate(picked), np.array([len(p) for p in picked]), y[ids], balance[ids] / len(ids))
            net.tables -= learn_t.step(tables.astype(np.float32) + 1e-5 * net.tables)
            net.offset -= learn_o.step(offset.astype(np.float32))
            net.out -= learn_w.step(out.astype(np.float32) + 1e-4 * net.out)
            net.bias -= float(learn_b.step(np.array([bias], np.float32))[0])
    return net


def train(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> ByteNet:
    """Fit to the bounded sample of labelled documents for which learn, over doc_id, holds."""
    sample, size = labelled_sample(documents, labels, "quality", per_class, MAX_CHARS, learn)
    rows = sample.toPandas().sort_values("doc_id", ignore_index=True)
    return fit([whole_sentences(t, size) for t in rows["text"]], rows["label"].astype(int).tolist())


def scorer(documents: DataFrame, model: ByteNet):
    """A column function: text -> score double."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(texts.tolist()), dtype=float)

    return score


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from folds other than 1 of 3."""
    slim = documents.select("doc_id", "text")
    held_out = id_fold(F.col("doc_id"), 3) == 1
    score = scorer(documents, train(slim, labels, ~held_out))
    return slim.select("doc_id", held_out.alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
