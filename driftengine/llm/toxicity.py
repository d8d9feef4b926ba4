"""Toxicity by character n-grams, scaled by naive Bayes log-count ratios, in a linear classifier.

Features are the byte n-grams inside the distinct words of a document, with a mark at either end of a
word, hashed into a fixed number of slots. The log-count ratios come from all labelled documents; a
logistic regression over the scaled features of all slots is fitted on a bounded sample and weights
its rows back to all labelled ones. A document is fitted and scored word by word: a slot counts once for
each distinct word with it, and the n-grams of a word are kept once for all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.classify import fitting_sample, held_out, labelled, sigmoid, smoothed_rate
from driftengine.llm.common import hashed_spans, mix, ramp, rows, texts, word_spans

#: Slots of the hashed n-grams, and their lengths in bytes, word marks included.
SLOTS, LENGTHS = 1 << 17, (3, 4, 5, 6)
#: Labelled rows of each label that the regression is fitted on.
SAMPLE = 3000
#: Distinct words of the sample whose n-grams the driver takes at a time; bounds its passing memory only.
PART = 1 << 14


def _word_grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, word) pairs as two arrays, and the slots of each distinct word's n-grams
    with the word they belong to."""
    raw, starts, stops, n_words = word_spans(docs, lower=True)
    hashes = hashed_spans(raw, starts, stops)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(docs)), n_words)
    pairs = np.unique(doc.astype(np.int64) * max(1, len(first)) + word)
    doc, of = pairs // max(1, len(first)), pairs % max(1, len(first))
    clean = np.where((raw >= 9) & (raw <= 13), 32, raw).astype(np.uint8)
    slots, owner = [], []
    for n in LENGTHS:
        count = np.maximum(0, stops[first] - starts[first] + 2 - n + 1)
        at = np.repeat(starts[first] - 1, count) + ramp(count)
        grams = np.full(len(at), n << 56, np.uint64)
        for j in range(n):
            grams |= clean[at + j].astype(np.uint64) << np.uint64(8 * j)
        slots.append((mix(grams) % np.uint64(SLOTS)).astype(np.int32))
        owner.append(np.repeat(np.arange(len(first)), count))
    return doc, of, np.concatenate(slots), np.concatenate(owner)


def _listed(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of the distinct (document, word) pairs, n-grams of each pair, and all their slots in turn."""
    doc, of, slots, owner = _word_grams(docs)
    order = np.argsort(owner, kind="stable")
    slots, size = slots[order], np.bincount(owner, minlength=of.max() + 1 if len(of) else 0)
    first = np.cumsum(size) - size
    n = size[of]
    return doc, n, slots[np.repeat(first[of], n) + ramp(n)]


def document_features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, slot and number of distinct words with it, for every slot a document has."""
    doc, n, slots = _listed(docs)
    key, count = np.unique(np.repeat(doc, n) * SLOTS + slots, return_counts=True)
    return key // SLOTS, key % SLOTS, count


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per slot, ratios included
    bias: float

    def score(self, docs: list[bytes]) -> np.ndarray:
        doc, of, slots, owner = _word_grams(docs)
        word = np.bincount(owner, self.weights[slots], minlength=of.max() + 1 if len(of) else 0)
        return sigmoid(np.bincount(doc, word[of], minlength=len(docs)) + self.bias)


def _counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each label, the labelled documents that have each slot; and the documents per label."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in rows(batches, 1 << 20):
            label = np.asarray(batch.column("label"))
            doc, slot, _ = document_features(texts(batch))
            np.add.at(total, (label[doc], slot), 1)
            n += np.bincount(label, minlength=2)
        used = np.flatnonzero(total.any(axis=0))
        # Slot -1 carries the number of documents.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), *(pa.array(np.append(total[y][used], n[y])) for y in (0, 1))],
            names=["slot", "n0", "n1"])

    found = train.mapInArrow(work, "slot long, n0 long, n1 long").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    docs = found[found.slot < 0][["n0", "n1"]].sum().to_numpy()
    found = found[found.slot >= 0]
    out = np.zeros((2, SLOTS))
    out[:, found.slot.to_numpy()] = found[["n0", "n1"]].to_numpy().T
    return out, docs


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents that are not held out.

    With no labelled rows, or rows of one label only, every text gets the smoothed share of label 1.
    """
    train = labelled(docs, labels, "toxic")
    counts, n = _counts(train)
    if n.min() == 0:
        rate = smoothed_rate(np.array([0, 1]), n)
        return Model(np.zeros(SLOTS, np.float32), float(np.log(rate / (1 - rate))))
    p = (counts + 1) / (n[:, None] + 2)
    ratio = np.log(p[1] / p[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 20):
            docs = texts(batch)
            doc, slot, count = document_features(docs)
            norm = np.bincount(doc, (count * ratio[slot]) ** 2, minlength=len(docs))
            words = [b" ".join(dict.fromkeys(d.lower().split())) for d in docs]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(norm), pa.array(words, pa.binary())],
                                             names=["label", "norm", "words"])

    chosen, weight = fitting_sample(train, sample)
    got = chosen.select("label", "text").mapInArrow(work, "label int, norm double, words binary").toArrow()
    y, norm = np.asarray(got.column("label")).astype(float), np.asarray(got.column("norm"))
    w, bias = _regression(got.column("words").to_pylist(), ratio, norm, y, np.where(y == 1, weight[1], weight[0]))
    return Model((w * ratio).astype(np.float32), bias)


def _regression(docs, ratio, norm, y, weight, steps: int = 300, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient steps on ratio-scaled features of all slots.
    ``docs`` are in lower case, ``norm`` has their squared feature norms; a word's slots are kept once."""
    number: dict[bytes, int] = {}
    of = [np.array([number.setdefault(w, len(number)) for w in dict.fromkeys(d.split())], np.intp) for d in docs]
    doc, of, words = np.repeat(np.arange(len(docs)), [len(x) for x in of]), np.concatenate(of), list(number)
    del number, docs
    parts = []  # words from and to, their first n-grams and numbers of n-grams, slots
    for at in range(0, len(words), PART):
        _, n, slots = _listed(words[at:at + PART])
        parts.append((slice(at, at + PART), np.cumsum(n) - n, n, slots))
    n_words = len(words)
    del words
    weight = weight / weight.sum()
    # A step length from the mean squared row norm (bounds the curvature).
    rate = 4.0 / (float(np.average(norm, weights=weight)) + 1.0)
    share = smoothed_rate(y, weight * len(y))
    w, b = np.zeros(SLOTS), float(np.log(share / (1 - share)))
    moment, moment_b = np.zeros(SLOTS), 0.0
    for _ in range(steps):
        ahead, ahead_b = w + 0.9 * moment, b + 0.9 * moment_b
        word, scaled = np.zeros(n_words), ahead * ratio
        for at, first, _, slots in parts:
            word[at] = np.add.reduceat(scaled[slots], first)  # no word is without n-grams
        error = (sigmoid(np.bincount(doc, word[of], minlength=len(y)) + ahead_b) - y) * weight
        word = np.bincount(of, error[doc], minlength=n_words)
        gradient = decay * ahead
        for at, _, n, slots in parts:
            gradient += np.bincount(slots, np.repeat(word[at], n), minlength=SLOTS) * ratio
        moment = 0.9 * moment - rate * gradient
        moment_b = 0.9 * moment_b - rate * error.sum()
        w, b = w + moment, b + moment_b
    return w, b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; empty and null texts get the score of no words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(texts(batch)))],
                                             names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, in a model fitted on it."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = fit(docs, labels)
    names = docs.columns
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            yield batch.filter(pa.array(model.score(texts(batch)) < threshold))

    return docs.select(*names).mapInArrow(work, schema)
