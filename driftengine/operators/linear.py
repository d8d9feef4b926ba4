"""Logistic heads fitted to their optimum by Newton steps, from sums that Spark makes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftengine.scale import materialize

ROUNDS, SETTLED = 50, 1e-10


@dataclass(frozen=True)
class LinearHead:
    """``weights`` and ``intercept`` on the features as they are, the ``gradient``'s largest entry (on
    standardised features) and the Newton ``steps`` it took."""

    features: tuple[str, ...] | str
    weights: np.ndarray
    intercept: float
    gradient: float
    steps: int

    def __call__(self, df: DataFrame) -> DataFrame:
        """Rows with ``prob`` of class 1; null where a feature is null."""
        x = _vector(self.features)
        z = F.aggregate(F.zip_with(x, F.lit(self.weights.tolist()), lambda a, w: a * w), F.lit(float(self.intercept)),
                        lambda total, t: total + t)
        return df.withColumn("prob", 1 / (1 + F.exp(-z)))

    def table(self, spark) -> DataFrame:
        """``feature, coefficient``, the intercept first; numbered where the features are one array."""
        named = [str(i) for i in range(len(self.weights))] if isinstance(self.features, str) else self.features
        rows = [("(intercept)", float(self.intercept)), *zip(named, map(float, self.weights))]
        return spark.createDataFrame(rows, "feature string, coefficient double")


def _vector(features: Sequence[str] | str) -> Column:
    cells = F.col(features) if isinstance(features, str) else F.array(*features)
    return cells.cast("array<double>")


def _cells(df: DataFrame, part, size: int) -> np.ndarray:
    """Sum over the rows of square matrices that ``part`` makes of a batch: in tasks, then per cell."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                total += part(np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float))
        i, j = np.indices((size, size))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    out = np.zeros((size, size))
    for c in df.mapInPandas(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[c.i, c.j] = c.v
    return out


def fit_newton(df: DataFrame, features: Sequence[str] | str, label: str = "label", l2: float = 1e-4) -> LinearHead:
    """Logistic regression: mean log loss plus ``l2 / 2`` times the squared weights of the standardised
    features (the intercept is free). ``features`` are columns or one array column.

    One pass gives means and products, then one pass a step gives loss, gradient and Hessian; the driver
    solves a system of the features' number. A step that does not lower the loss is halved. It ends
    when the gradient is zero to ``SETTLED``. With ``l2`` above 0 the optimum is unique, whatever the
    data. Rows with a null label or feature take no part; constant features have weight 0.
    """
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c))
    rows = materialize(df.select(_vector(features).alias("x"), (F.col(label) == 1).cast("double").alias("y")).where(
        whole & F.col("y").isNotNull()))
    head = rows.select(F.size("x")).first()
    if head is None:
        raise ValueError("no rows to fit")
    d = head[0]

    def moments(x, y):
        a = np.column_stack([np.ones(len(x)), x])
        return a.T @ a

    m = _cells(rows, moments, d + 1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]

    def spread(x, y):
        return np.diag(((x - mean) ** 2).sum(axis=0))

    sd = np.sqrt(np.diag(_cells(rows, spread, d)) / n)
    used = sd > 1e-12 * np.maximum(np.abs(mean), 1e-300)
    sd = np.where(used, sd, 1.0)
    w = np.zeros(d + 1)
    penalty = np.concatenate([[0.0], np.full(d, l2)])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(x, y):
            a = np.column_stack([np.ones(len(x)), np.where(used, (x - mean) / sd, 0.0)])
            z = a @ w
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            out = np.zeros((d + 2, d + 2))
            out[:-1, :-1] = (a * (p * (1 - p))[:, None]).T @ a
            out[:-1, -1] = a.T @ (p - y)
            out[-1, -1] = (np.logaddexp(0, z) - y * z).sum()
            return out

        s = _cells(rows, sums, d + 2) / n
        return s[-1, -1] + (penalty * w * w).sum() / 2, s[:-1, -1] + penalty * w, s[:-1, :-1] + np.diag(penalty)

    loss, gradient, hessian = at(w)
    steps = 0
    while np.abs(gradient).max() > SETTLED and steps < ROUNDS:
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        for half in range(30):
            tried = at(w - move / 2 ** half)
            if tried[0] <= loss + 1e-15:
                break
        if tried[0] > loss + 1e-15:
            break
        w, (loss, gradient, hessian) = w - move / 2 ** half, tried
        steps += 1
    weights = np.where(used, w[1:] / sd, 0.0)
    return LinearHead(features if isinstance(features, str) else tuple(features), weights, float(w[0] - (weights * mean).sum()),
                      float(np.abs(gradient).max()), steps)
