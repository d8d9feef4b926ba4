"""Text quality: random-indexing word vectors, pooled per document, in a two-layer network.

Every token (a run of letters and digits, or of other characters) is hashed to one of ``WORDS``
entries. An entry has a fixed sparse index vector; its word vector is the sum of the index vectors of
its neighbours over all documents. A document is the mean and spread of its tokens' vectors, rare
tokens weighing more, and the mean likeness of neighbouring ones. A network with one hidden layer is
fitted with numpy on a bounded sample of the labelled documents, and a temperature fitted on a part
it has not seen calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.classify import fitting_sample, held_out, labelled, sigmoid, smoothed_rate
from driftengine.llm.common import hashed_spans, mix, rows, texts

#: Entries of the word table and numbers of a word vector; together they bound what is broadcast.
WORDS, DIMS = 1 << 14, 32
#: Neighbours on either side, and non-zero numbers of an index vector.
REACH, NONZERO = 2, 2
#: Labelled documents of each label that the network is fitted on, and its hidden units.
SAMPLE, HIDDEN = 8000, 32
#: Weight of a token: a / (a + its share of all tokens).
RARE = 1e-3

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 others
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def token_entries(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table entry of every token, and the number of tokens of each text."""
    raw = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    starts = edge[kind[edge] != 0]
    stops = np.append(edge, len(raw))[np.searchsorted(edge, starts) + 1]
    upto = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in docs]))
    return (hashed_spans(raw, starts, stops) % np.uint64(WORDS)).astype(np.int64), np.diff(upto, prepend=0)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero numbers of every entry."""
    h = mix(np.arange(WORDS * NONZERO, dtype=np.uint64) + np.uint64(977)).reshape(WORDS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def context_sums(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Over all documents: summed index vectors of the neighbours of each entry, and its count. Each
    task sends one row per entry at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, sign = _index_vectors()
        total, count = np.zeros(WORDS * DIMS), np.zeros(WORDS, np.int64)
        for batch in rows(batches):
            token, n = token_entries(texts(batch))
            doc = np.repeat(np.arange(len(n)), n)
            count += np.bincount(token, minlength=WORDS)
            for step in range(1, REACH + 1):
                same = np.flatnonzero(doc[step:] == doc[:-step])
                for a, b in ((token[same], token[same + step]), (token[same + step], token[same])):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIMS + where[b, j], sign[b, j], minlength=WORDS * DIMS)
        used = np.flatnonzero(count)
        sums = total.reshape(WORDS, DIMS)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), *(pa.array(sums[:, j]) for j in range(DIMS))],
            names=["entry", "n", *(f"d{j}" for j in range(DIMS))])

    schema = "entry long, n long, " + ", ".join(f"d{j} long" for j in range(DIMS))
    found = docs.select("text").mapInArrow(work, schema).groupBy("entry").agg(
        F.sum("n").alias("n"), *[F.sum(f"d{j}").alias(f"d{j}") for j in range(DIMS)]).toPandas()
    sums, count = np.zeros((WORDS, DIMS)), np.zeros(WORDS)
    entry = found.entry.to_numpy()
    sums[entry], count[entry] = found[[f"d{j}" for j in range(DIMS)]].to_numpy(), found.n.to_numpy()
    return sums, count


@dataclass(frozen=True)
class Pooling:
    vectors: np.ndarray  # unit length, one row per entry
    weight: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, count: np.ndarray) -> Pooling:
        common = sums.sum(axis=0) / max(1.0, count.sum())
        vectors = sums / np.maximum(count, 1)[:, None] - common
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        share = count / max(1.0, count.sum())
        return cls((vectors / np.maximum(length, 1e-12)).astype(np.float32), (RARE / (RARE + share)).astype(np.float32))

    def features(self, docs: list[bytes]) -> np.ndarray:
        token, n = token_entries(docs)
        out = np.zeros((len(docs), 2 * DIMS + 3), np.float32)
        full = np.flatnonzero(n)
        if not len(full):
            return out
        first = (np.cumsum(n) - n)[full]
        vectors, weight = self.vectors[token], self.weight[token]
        total = np.add.reduceat(weight, first)[:, None]
        mean = np.add.reduceat(vectors * weight[:, None], first) / total
        square = np.add.reduceat(vectors * vectors * weight[:, None], first) / total
        doc = np.repeat(np.arange(len(docs)), n)
        inner = doc[1:] == doc[:-1]
        near = np.bincount(doc[1:][inner], np.einsum("ij,ij->i", vectors[1:], vectors[:-1])[inner], minlength=len(docs))
        out[full, :DIMS] = mean
        out[full, DIMS:2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, -3] = near[full] / np.maximum(n[full] - 1, 1)
        out[full, -2] = total[:, 0] / n[full]
        out[full, -1] = np.log1p(n[full])
        return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2) / self.temperature


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on mini-batches of four fifths of the rows; the temperature minimises the loss of the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    rest, train = order[: len(y) // 5], order[len(y) // 5:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[part] @ p[0] + p[1])
            error = (sigmoid(h @ p[2] + p[3]) - y[part]) * weight[part] / weight[part].sum()
            back = error[:, None] * p[2] * (1 - h * h)
            gradient = [z[part].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            t += 1
            for j, g in enumerate(gradient):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 3e-3 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not len(rest):
        return net
    raw, yr, wr = net.logits(x[rest]), y[rest], weight[rest]

    def loss(temperature: float) -> float:
        q = np.clip(sigmoid(raw / temperature), 1e-9, 1 - 1e-9)
        return float(-(wr * (yr * np.log(q) + (1 - yr) * np.log(1 - q))).sum())

    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(best))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Pooling, Network | float]:
    """Word vectors from all documents, the network from labelled ones that are not held out. With no
    labelled rows, or rows of one label only, the smoothed share of label 1 stands for the network."""
    pooling = Pooling.of(*context_sums(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            x = pooling.features(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    chosen, weight = fitting_sample(labelled(docs, labels, "quality"), sample)
    got = chosen.select("label", "text").mapInArrow(work, "label int, x binary").toArrow()
    y = np.asarray(got.column("label")).astype(float)
    w = np.where(y == 1, weight[1], weight[0])
    if len(np.unique(y)) < 2:
        return pooling, smoothed_rate(y, w)
    x = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in got.column("x")]).astype(float)
    order = np.lexsort((*x.T, y))  # the same network whatever order the rows came in
    return pooling, fit_network(x[order], y[order], w[order])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted of every row of ``docs``.

    Null and empty texts have the features of no tokens and get a score too. Null ids count as held
    out and stay null; repeated rows are scored alike; other columns are not read.
    """
    pooling, network = fit(docs, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            if isinstance(network, float):
                p = np.full(batch.num_rows, network)
            else:
                p = sigmoid(network.logits(pooling.features(texts(batch)).astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
