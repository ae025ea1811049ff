"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document,
a softmax on top, trained by plain numpy stochastic gradient descent.

A word's vector is the mean of its own and those of its character n-grams; a word bigram's that of its two words and
that of their relation (equal or not), so that repetition is learnt for words that training didn't see.  A document
is the mean over its words and bigrams.  All vectors are rows of one hashed table.

``fit`` runs on the driver over a bounded sample of labelled texts (the bound is a parameter).  As the
model is linear after averaging, scoring folds vectors and softmax weights into one row of class scores
per feature, so a document of any length is scored whole in one pass over its words.

Defined results: null and empty texts have no features and get the prior alone; a training table without
rows gives uniform scores; texts of any length are read whole when scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .textkit import Words, mix, slices, word_hash

U = np.uint64
#: Most that a step on one feature is raised over the step on an average one.
GAIN = 8.0


@dataclass
class SubwordModel:
    """``table[f]`` holds a feature's class scores; ``bias`` the class scores of a text without features."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    sizes: tuple[int, ...] = (3, 4, 5)


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return first, inverse


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % U(buckets)).astype(np.int64)


def word_features(w: Words, words: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the given words' features and the word (as a position in ``words``) each belongs to.

    A word's features: itself, and its n-grams of characters with one white space kept at either end as a mark.
    """
    start, length = w.start[words], w.length[words]
    total = length + 2
    begin = np.cumsum(total) - total
    owner = np.repeat(np.arange(len(words)), total)
    inner = np.arange(int(total.sum())) - begin[owner]
    flat = np.zeros(int(total.sum()) + 16, np.uint8)
    body = (inner > 0) & (inner <= length[owner])
    flat[: len(inner)][body] = w.data[(start[owner] + inner - 1)[body]]
    flat[: len(inner)][~body] = 32
    char = np.flatnonzero((flat[: len(inner)] & 0xC0) != 0x80)  # where characters begin
    owner, edge = owner[char], np.append(char, len(inner))
    last = np.searchsorted(owner, owner, side="right")
    found, of = [w.hash[words]], [np.arange(len(words))]
    for n in sizes:
        at = np.flatnonzero(np.arange(len(char)) + n <= last)
        found.append(word_hash(flat, char[at], edge[at + n] - char[at]))
        of.append(owner[at])
    return _bucket(np.concatenate(found), buckets), np.concatenate(of)


def bigram_features(w: Words, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket by words and bucket by relation of every word bigram."""
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    one, two = w.hash[inside], w.hash[inside + 1]
    return doc[inside], _bucket(mix(one) + two, buckets), _bucket((one == two) + U(1), buckets)


def document_scores(w: Words, model: SubwordModel) -> np.ndarray:
    """Softmax probabilities, one row per text."""
    n, k = len(w.off) - 1, model.table.shape[1]
    total, count = np.zeros((n, k)), np.zeros(n)
    if len(w.hash):
        first, inverse = _distinct(w)
        feat, of = word_features(w, first, len(model.table), model.sizes)
        per = np.bincount(of, minlength=len(first))
        doc = w.doc_of()
        of_pair, words, relation = bigram_features(w, doc, len(model.table))
        count = np.diff(w.off) + np.bincount(of_pair, minlength=n)
        for c in range(k):
            score = np.bincount(of, model.table[feat, c], len(first)) / per
            total[:, c] = np.bincount(doc, score[inverse], n) + np.bincount(of_pair, (model.table[words, c] + model.table[relation, c]) / 2, n)
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def _shares(text: str, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares of its mean."""
    w = Words(pa.array([text or ""]))
    if not len(w.hash):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    first, inverse = _distinct(w)
    feat, of = word_features(w, first, buckets, sizes)
    times = np.bincount(inverse, minlength=len(first)) / np.bincount(of, minlength=len(first))
    _, words, relation = bigram_features(w, w.doc_of(), buckets)
    idx, back = np.unique(np.concatenate([feat, words, relation]), return_inverse=True)
    weight = np.bincount(back, np.concatenate([times[of], np.full(2 * len(words), 0.5)]))
    return idx.astype(np.int32), (weight / weight.sum()).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, classes: int, prior: np.ndarray | None = None, dim: int = 16, buckets: int = 1 << 17, epochs: int = 6, rate: float = 0.6, seed: int = 7, sizes: tuple[int, ...] = (3, 4, 5)) -> SubwordModel:
    """Train on a bounded sample; ``prior`` restores class shares when the sample is balanced."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    weights = rng.normal(0, 0.1, (dim, classes))
    bias = np.zeros(classes)
    docs = [_shares(text, buckets, sizes) for text in texts]
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            idx, share = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[idx] if len(idx) else np.zeros(dim)
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            if len(idx):
                # averaging divides each step by the feature count; it is multiplied in again, up to a unit step of the mean
                gain = np.minimum(share * len(idx), GAIN)
                vectors[idx] -= (lr * gain / max(1.0, float(share @ gain)))[:, None] * back
    if prior is not None and len(docs):
        seen = np.bincount(labels, minlength=classes) / len(docs)
        bias = bias + np.log(np.maximum(prior, 1e-6)) - np.log(np.maximum(seen, 1e-6))
    return SubwordModel((vectors @ weights).astype(np.float32), bias, 1.0, sizes)


def score_documents(docs: DataFrame, model: SubwordModel, keep: list[str], text: str = "text", out: str = "probs", words: str | None = None) -> DataFrame:
    """``keep`` columns plus ``out`` (array of class probabilities), one row per document, no shuffle.

    ``words`` names a further column with the number of words.
    """
    ship(texts=True)
    # buckets x classes floats: a fixed size; plain values, as broadcasts are pickled by reference
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.temperature, model.sizes))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))] + ([T.StructField(words, T.LongType())] if words else []))

    def run(batches):
        model = SubwordModel(*shared.value)
        for b in slices(batches, text):
            w = Words(b.column(text))
            cols = [*(b.column(c) for c in keep), pa.array(list(document_scores(w, model)), pa.list_(pa.float64()))]
            cols += [pa.array(np.diff(w.off))] * bool(words)
            yield pa.record_batch(cols, [*keep, out, words] if words else [*keep, out])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
