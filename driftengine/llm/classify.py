"""What the two text classifiers share: labels, the held-out fold, and a bounded fitting sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftengine.llm.common import sized_join


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents, by the CRC-32 of the id as text (null as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """doc_id, text and label (0 or 1) of the documents to learn from: labelled and not held out.

    Null labels and ids teach nothing; of repeated labels the largest counts.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return sized_join(docs.select("doc_id", "text"), known, "doc_id", width=16, how="inner")


def fitting_sample(rows: DataFrame, most: int, seed: int = 11) -> tuple[DataFrame, dict[int, float]]:
    """At most ``most`` rows of each label in a seeded order, and each label's rows in all per row in
    the sample (its weight). The ids of the sample are broadcast; ``most`` bounds them."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    keyed = rows.select("doc_id", "label", order.alias("o")).distinct()
    total = {r.label: r.n for r in keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [keyed.where(F.col("label") == y).orderBy("o").limit(most) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id")
    weight = {y: max(1.0, total.get(y, 0) / most) for y in (0, 1)}
    return rows.join(F.broadcast(ids), "doc_id", "left_semi"), weight


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def smoothed_rate(y: np.ndarray, w: np.ndarray) -> float:
    """Weighted share of label 1, never 0 or 1."""
    return float(((y * w).sum() + 0.5) / (w.sum() + 1))
