"""k-means for all numbers of clusters at once: one pass over the rows a round, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftengine.scale import hash_order, materialize

ROUNDS = 20
#: Rows whose distances to all centres are in memory at once.
STEP = 4096


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        for i in range(0, len(pdf), STEP):
            part = pdf.iloc[i:i + STEP]
            yield part, np.stack(part["x"].to_numpy()).astype(float)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _cluster_sums(rows: DataFrame, centres: dict[int, np.ndarray]) -> pd.DataFrame:
    """``k, cluster, n, inertia, norms, total`` of every cluster of every k, from one pass."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {k: (np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)) for k, c in centres.items()}
        for _, x in _steps(batches):
            norms = (x * x).sum(axis=1)
            for k, c in centres.items():
                d = _squared(x, c)
                near = d.argmin(axis=1)
                n, inertia, square, total = held[k]
                n += np.bincount(near, minlength=len(c))
                inertia += np.bincount(near, d[np.arange(len(x)), near], len(c))
                square += np.bincount(near, norms, len(c))
                np.add.at(total, near, x)
        yield pd.DataFrame([(k, i, *(float(h[i]) for h in held[k][:3]), held[k][3][i].tolist())
                            for k, c in centres.items() for i in range(len(c))],
                           columns=["k", "cluster", "n", "inertia", "norms", "total"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        for c in ("n", "inertia", "norms"):
            out[c] = pdf[c].sum()
        out["total"] = [np.sum(np.stack(pdf["total"].to_numpy()), axis=0).tolist()]
        return out

    schema = "k int, cluster int, n double, inertia double, norms double, total array<double>"
    # As many rows as there are centres.
    found = rows.mapInPandas(work, schema).groupBy("k", "cluster").applyInPandas(merge, schema).toPandas()
    return found.sort_values(["k", "cluster"])


def lloyd_sweep(
    df: DataFrame, features: str, ks: Sequence[int] = tuple(range(3, 16)), key: str = "id", rounds: int = ROUNDS, seed: int = 42,
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``K, inertia, silhouette_score, is_best`` for every number of clusters, and their centres.

    The first rows in hash order of ``key`` are the seeds, the same for all K. A round reads the rows
    once: each goes to its nearest centre of every K, the first on ties, and counts and sums per centre
    are all that is moved. A centre without rows stays. It ends when no inertia falls any more, after
    ``rounds`` at most; inertia is that of the centres returned. The silhouette (squared distances)
    takes one more pass with the clusters' sums. Rows with a null vector or key take no part.
    """
    rows = materialize(df.where(F.col(features).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x")))
    first = rows.orderBy(hash_order("key", seed), "key").limit(max(ks)).select("x").collect()  # a row a cluster
    starts = np.array([r.x for r in first], float)
    centres = {k: starts[:k].copy() for k in ks if k <= len(starts)}
    if not centres:
        return rows.sparkSession.createDataFrame([], "K int, inertia double, silhouette_score double, is_best boolean"), {}
    before: dict[int, float] = {}
    for _ in range(rounds + 1):
        sums = _cluster_sums(rows, centres)
        inertia = sums.groupby("k")["inertia"].sum().to_dict()
        moving = [k for k in centres if k not in before or inertia[k] < before[k] * (1 - 1e-12)]
        if not moving or _ == rounds:
            break
        before = inertia
        for k in moving:
            mine = sums[sums["k"] == k]
            n = mine["n"].to_numpy()
            means = np.stack(mine["total"].to_numpy()) / np.maximum(n, 1)[:, None]
            centres[k] = np.where((n > 0)[:, None], means, centres[k])
    scores = _silhouettes(rows, centres, sums)
    best = max(scores, key=lambda k: (scores[k], -k))
    table = [(int(k), float(inertia[k]), float(scores[k]), k == best) for k in sorted(centres)]
    return rows.sparkSession.createDataFrame(table, "K int, inertia double, silhouette_score double, is_best boolean"), centres


def _silhouettes(rows: DataFrame, centres: dict[int, np.ndarray], sums: pd.DataFrame) -> dict[int, float]:
    """Mean silhouette with squared distances for every k: means over a cluster follow from its sums."""
    stats = {k: (g["n"].to_numpy(), g["norms"].to_numpy(), np.stack(g["total"].to_numpy())) for k, g in sums.groupby("k")}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = dict.fromkeys(centres, 0.0), 0
        for _, x in _steps(batches):
            count += len(x)
            norms = (x * x).sum(axis=1)[:, None]
            for k, c in centres.items():
                n, square, whole = stats[k]
                near = _squared(x, c).argmin(axis=1)
                to = np.maximum(n * norms - 2 * x @ whole.T + square, 0)  # sums over each cluster
                at = np.arange(len(x))
                a = to[at, near] / np.maximum(n[near] - 1, 1)
                mean = np.where(n > 0, to / np.maximum(n, 1), np.inf)
                mean[at, near] = np.inf
                b = mean.min(axis=1)
                known = (n[near] > 1) & np.isfinite(b)
                s = np.where(known, (b - a) / np.where(known, np.maximum(np.maximum(a, b), 1e-300), 1), 0.0)
                total[k] += float(s.sum())
        yield pd.DataFrame({"k": list(total), "s": list(total.values()), "n": [float(count)] * len(total)})

    got = rows.mapInPandas(work, "k int, s double, n double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return {r.k: r.s / r.n for r in got}


def nearest(features: str, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first on ties."""
    x = F.col(features).cast("array<double>")
    distances = [F.aggregate(F.zip_with(x, F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
                 for c in centres]
    all_of = F.array(*distances)
    return (F.array_position(all_of, F.array_min(all_of)) - 1).cast("int")
