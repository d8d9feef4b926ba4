"""Whitening of embeddings with eigenvectors refined in higher precision.

The covariance is a sum over the distinct vectors, made in tasks. Its eigenvectors are first computed
in float32; iterations after Ogita and Aishima, which are matrix products only, correct them in
extended precision. Where eigenvalues are too close for a correction to tell their vectors apart, the
covariance restricted to that cluster's subspace is solved on its own, with the cluster's mean taken
off so that its small differences keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.common import stored

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this count as not finite: products with SCALE stay exact in doubles and longs.
LARGEST = 2.0 ** 46
COMPONENTS = 16
#: A component of less than this share of the first one's variance has no direction to speak of.
NEGLIGIBLE = 2.0 ** -45
ROUNDS = 20
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")
_WIDE = np.longdouble  # 64 bits of mantissa on x86


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector in whole numbers, of the vectors that take part."""
    usable = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, x).alias("x"))
    found = found.where("size(x) > 0")
    sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return found.where(F.size("x") == (sizes[0].d if sizes else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), -1)


def _summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum of ``part(rows)`` (a matrix) over all rows: added up in each task, then row by row of the
    matrix in as many tasks as it has rows. What comes back has the matrix's size, whatever the input's."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = part(_matrix(batch))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], ["i", "v"])

    def merge(table: pa.Table) -> pa.Table:
        v = np.stack([np.asarray(r) for r in table.column("v").to_pylist()]).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([v])})

    schema = f"i int, v array<{kind}>"
    found = df.mapInArrow(add, schema).groupBy("i").applyInArrow(merge, schema).collect()
    return np.array([r.v for r in sorted(found, key=lambda r: r.i)])


def _norm(m: np.ndarray) -> float:
    return float(np.linalg.norm(m.astype(float), 2))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of two or more values whose neighbours are at most ``gap`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in extended
    precision. Vectors of a multiple eigenvalue are an orthonormal basis of its space."""
    a = a.astype(_WIDE)
    unit = np.eye(len(a), dtype=_WIDE)
    size = np.abs(a).max(initial=0)
    if size == 0:
        return np.zeros(len(a), _WIDE), unit
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_WIDE)
    norm, noise = _norm(a), len(a) * float(np.finfo(_WIDE).eps)
    for _ in range(ROUNDS):
        r, s = unit - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = 2 * (_norm(s - np.diag(values)) + norm * _norm(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        for group in _clusters(values, gap):
            inside = x[:, group]
            centre = values[group].mean()
            small = inside.T @ (a @ inside - centre * inside)
            small = (small + small.T) / 2
            spread = np.abs(small).max()
            if spread > noise:  # otherwise the eigenvalue is a multiple one as far as can be told
                x[:, group] = inside @ np.linalg.eigh((small / spread).astype(float))[1].astype(_WIDE)
        if np.abs(e).max() <= noise and gap <= 4 * noise:
            break
    for _ in range(3):  # a correction within a very close cluster leaves its square as an error
        x = x + x @ ((unit - x.T @ x) / 2)
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum over the dimensions of (n x - S)^2; null where it is too large for a long."""
    if n * int(np.abs(x).max()) < 1 << 62:
        d = n * x - sums
        if int(np.abs(d).max()) ** 2 * x.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector: vec_id, component (1 has the largest variance), n (distinct
    vectors), deviation, whitened, explained (share of the whole variance) and identity_error, the
    largest absolute entry of the whitened distinct vectors' covariance minus the identity.

    Mean and covariance are those of the distinct vectors, so copies do not count. Vectors that are
    null or hold null, non-finite or too large entries (``LARGEST``) take no part, nor do those of
    another length than the most frequent one (the shorter on ties). Null and repeated ids stay as
    they are, an empty table gives no rows, other columns are ignored. A component without variance
    has a null ``whitened`` and is not part of identity_error, which is null if there is no other;
    without any variance ``explained`` is null as well.

    Products of the covariance are exact while their sums are below 2^53; the driver holds matrices of
    the vectors' length squared, tasks one more of them.
    """
    every = integer_vectors(vectors)
    fit = stored(every.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    sums = _summed(fit, lambda x: x.sum(axis=0, keepdims=True), "long")[0]
    whole = np.array([(2 * int(s) + n) // (2 * n) for s in sums])  # the mean, rounded
    rest = np.array([int(s) - n * int(w) for s, w in zip(sums, whole)]).astype(_WIDE) / n

    def products(x: np.ndarray) -> np.ndarray:
        d = (x - whole).astype(float)
        return d.T @ d

    covariance = _summed(fit, products, "double").astype(_WIDE) / n - np.outer(rest, rest)
    values, axes = eigenvectors(covariance)
    k = min(components, len(values))
    kept = [bool(v > 0 and v >= NEGLIGIBLE * values[0]) for v in values[:k]]
    project = np.array(axes[:, :k] / np.sqrt(np.where(kept, values[:k], 1)), float)
    trace = np.trace(covariance)
    explained = [float(v / trace) if trace > 0 else None for v in values[:k]]
    rest = rest.astype(float)

    def coordinates(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ project

    def second(x: np.ndarray) -> np.ndarray:
        w = coordinates(x)
        return np.vstack([w.sum(axis=0), w.T @ w])

    moments = _summed(fit, second, "double") / n
    error = np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k))[np.ix_(kept, kept)]
    error = float(error.max()) if any(kept) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x = _matrix(part)
                m = len(x)
                none = np.tile(~np.array(kept), m)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(coordinates(x).ravel(), mask=none),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return every.mapInArrow(work, SCHEMA)
