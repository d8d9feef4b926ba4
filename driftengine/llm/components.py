"""Connected components by alternating large and small stars, with components found inside of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from driftengine.llm.common import shared_path, stored

#: Edges that a task joins into components at once.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a list of edges: every node that is not its component's smallest, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[one], label[two])
        # Both ends, and the nodes that they follow, take the smaller label; then all follow theirs.
        for end in (label[one], label[two], one, two):
            np.minimum.at(label, end, least)
        while (label[label] != label).any():
            label = label[label]
        if (label[one] == label[two]).all():
            break
    inside = label != np.arange(len(nodes))
    return nodes[inside], nodes[label[inside]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with each chunk of a task's edges as stars (a > b), and the chunk's number."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), chunk))], names=["a", "b", "chunk"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield emit()
                held, n, chunk = [], 0, chunk + 1
        if n:
            yield emit()

    return edges.select("a", "b").mapInArrow(work, "a long, b long, chunk long")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple, bool]:
    """Contracted edges, stored; their number and sum of hashes; whether one chunk held them all."""
    seen = Observation()
    found = _contracted(edges).observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    path = shared_path(edges.sparkSession, "edges")
    found.write.parquet(path)
    out = edges.sparkSession.read.schema("a long, b long, chunk long").parquet(path).select("a", "b")
    s = seen.get
    return out, (s["n"], s["h"]), s["first"] == s["last"]


def _joined(edges: DataFrame) -> tuple[DataFrame, tuple, bool]:
    """``_written``; what tasks leave is read as one chunk if it was counted to be no more than one."""
    e, state, whole = _written(edges)
    if not whole and state[0] <= CHUNK:
        e, state, whole = _written(e.coalesce(1))
    return e, state, whole


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to node and root, the smallest node it is connected to; roots are not listed.

    Tasks join their own edges first, ``CHUNK`` at a time, and go on with one edge a node. If one chunk
    holds what is left, that is the answer. Otherwise every round sends each node's larger neighbours,
    then its smaller ones, to the smallest node around it, until the edges are stars; the number of
    rounds grows with the logarithm of the longest path. Minima are combined before they are shuffled
    and stored before they are joined, so AQE can split a hub's many edges. Edges may repeat.
    """
    e, before, whole = _joined(edges.where("a <> b"))
    while before[0] and not whole:
        both = e.union(e.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # A node keeps its edge to the smallest; its other smaller neighbours get one too.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        others = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e, after, whole = _joined(others.union(least).distinct())
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
