"""Exact top-k search by integer inner product, with a uniform threshold in three phases.

The dimensions are cut into slices; a score is the sum of its slices' partial scores. Vectors are
dealt into blocks of bounded size, queries too, and every query block meets every vector block once
in each pass. Vectors go there in as few bytes as their largest component needs. The two meet in a shuffle:
Spark takes a side's stored size for its size, however often it is repeated, and would broadcast it.

1. Each block lists, per query and slice, the vectors with the highest partial scores, and the
   slice's lowest partial score. The k-th best total among the listed vectors of all blocks is a
   safe cutoff: no result scores less.
2. The cutoffs go back to the blocks, next to their queries. A vector that reaches the cutoff must in
   some slice be above the lowest partial score by its even share of (cutoff - sum of the lowest
   ones), so each block collects the vectors that do so in any slice.
3. Their totals are resolved exactly; those reaching the cutoff are merged, k a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftengine.llm.common import stored

#: Vectors and queries that are multiplied at once: a pass holds their product a few times.
BLOCK, QUERY_BLOCK = 4096, 256
#: Vectors of a block that one task holds are no more than that many times ``BLOCK``, and as few as give each core some blocks.
WIDEST, A_CORE = 8, 4
SLICES = 4
LONG = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v = floor(256 * x) of each usable vector, one row per id.

    Null ids and vectors, and vectors with null or non-finite components are left out. Of rows with
    the same id the smallest vector counts. Components saturate at 64 bits.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    df = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & usable)
    v = F.transform(x, lambda c: F.floor(c * 256))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(values: pa.Array, dims: int, kind) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    ends = np.asarray(values.offsets)[1:] - values.offsets[0].as_py()
    flat = np.asarray(values.flatten())
    lengths = np.diff(ends, prepend=0)
    out = np.zeros((len(lengths), dims), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out.astype(kind)


def _narrow(vectors: DataFrame, dims: int, width: np.dtype) -> DataFrame:
    """id and the ``dims`` components as bytes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.ascontiguousarray(_matrix(batch.column("v"), dims, width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([row.tobytes() for row in made], pa.binary())], names=["id", "v"])

    return vectors.select("id", "v").mapInArrow(work, "id long, v binary")


def _integers(values: pa.Array, dims: int, width: np.dtype) -> np.ndarray:
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(width).reshape(-1, dims)


def _pairs(batches: Iterator[pa.RecordBatch], dims: int, width: np.dtype, kind, block: int):
    """Queries, their ids and, for each ``block`` vectors, vector ids, slices of partial scores and which
    vector is the query, of each pair of blocks."""
    cuts = np.linspace(0, dims, SLICES + 1).astype(int)

    def products(q: pa.Array, v: pa.Array):
        left, right = (_integers(s.field("v"), dims, width) for s in (q, v))
        q_ids, v_ids = (np.asarray(s.field("id")) for s in (q, v))
        left = left.astype(kind)
        for at in range(0, len(v_ids), block):
            some, ids = right[at:at + block].astype(kind), v_ids[at:at + block]
            yield ids, [left[:, a:b] @ some[:, a:b].T for a, b in zip(cuts, cuts[1:])], q_ids[:, None] == ids[None, :]

    for batch in batches:
        for at in range(batch.num_rows):
            q = batch.column("queries")[at].values
            yield q, np.asarray(q.field("id")), products(q, batch.column("vectors")[at].values)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` vectors with the highest scores for each query, except the query's own id:
    query_id, rank (from 1), vec_id, score. Equal scores go to the smaller vec_id; with fewer than
    ``k`` others all are returned. Both tables come from ``integer_vectors``. Vectors of unequal
    lengths are filled with zeros, scores saturate at 64 bits, an empty side gives no rows.
    """
    vectors = stored(vectors, "vectors")
    n, dims, top = vectors.agg(
        F.count(F.lit(1)), F.max(F.size("v")),
        F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    queries = stored(queries, "queries")
    m, q_dims, q_top = queries.agg(
        F.count(F.lit(1)), F.max(F.size("v")),
        F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    dims = max(dims or 0, q_dims or 0, SLICES)
    bound = dims * (top or 0) * (q_top or 0)
    # Products below 2**53 are exact in doubles, below 2**63 in longs, beyond in Python integers.
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    largest = max(top or 0, q_top or 0)
    width = np.dtype(next(t for t in ("i1", "i2", "i4", "i8") if t == "i8" or largest < 2 ** (8 * np.dtype(t).itemsize - 1)))
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / (WIDEST * block)), min(math.ceil(n / block), A_CORE * slots))
    q_blocks = max(1, math.ceil(m / query_block))
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    packed = stored(_narrow(vectors, dims, width).groupBy(deal(blocks).alias("block")).agg(
        F.collect_list(F.struct("id", "v")).alias("vectors")), "vector-blocks")
    queries = _narrow(queries, dims, width)

    def paired(q: DataFrame) -> DataFrame:
        grouped = q.groupBy(deal(q_blocks).alias("q_block")).agg(F.collect_list(F.struct(*q.columns)).alias("queries"))
        every = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts = min(blocks, A_CORE * slots)  # given, as the work on a block is not told by its bytes
        return every.repartition(parts, "block").join(packed.repartition(parts, "block").hint("merge"), "block").select(
            "queries", "vectors")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q_ids, products in _pairs(batches, dims, width, kind, block):
            best, lows = [[] for _ in q_ids], []
            for _, parts, own in products:
                total = sum(parts)
                listed = np.zeros(total.shape, bool)
                for p in parts:
                    if p.shape[1] > k + 1:  # one more, as the query itself may be among them
                        near = np.argpartition(-p, k, axis=1)[:, : k + 1]
                        np.put_along_axis(listed, near, True, axis=1)
                    else:
                        listed[:] = True
                listed &= ~own
                lows.append(np.stack([p.min(axis=1) for p in parts], axis=1))
                best = [sorted([*b, *(_long(x) for x in total[i, listed[i]])], reverse=True)[:k] for i, b in enumerate(best)]
            low = np.min(lows, axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids, pa.int64()), pa.array(best, pa.list_(pa.int64())),
                 pa.array([[_long(x) for x in r] for r in low], pa.list_(pa.int64()))], names=["id", "totals", "low"])

    found = stored(paired(queries).mapInArrow(lists, "id long, totals array<long>, low array<long>"), "score-lists")
    best = Window.partitionBy("id").orderBy(F.desc("t"))
    cutoff = found.select("id", F.explode("totals").alias("t")).withColumn("r", F.row_number().over(best)).where(
        F.col("r") <= k).groupBy("id").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("c"))
    low = found.groupBy("id").agg(*[F.min(F.col("low")[j]).alias(f"l{j}") for j in range(SLICES)])
    bounds = low.join(cutoff.hint("merge"), "id", "left").select(
        "id", F.when(F.col("c") == k, F.col("t")).alias("cutoff"),
        F.array(*[F.col(f"l{j}") for j in range(SLICES)]).alias("low"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, q_ids, products in _pairs(batches, dims, width, kind, block):
            cut, lowest = q.field("cutoff").to_pylist(), q.field("low").to_pylist()
            for v_ids, parts, own in products:
                yield reaching(q_ids, cut, lowest, v_ids, parts, own)

    def reaching(q_ids, cut, lowest, v_ids, parts, own) -> pa.RecordBatch:
        enough = np.zeros(own.shape, bool)
        for i, (c, lows) in enumerate(zip(cut, lowest)):
            if c is None or kind is object or abs(c) == LONG:
                enough[i] = True
                continue
            share = (c - sum(lows)) // SLICES  # rounded down, so nothing is missed
            for p, base in zip(parts, lows):
                enough[i] |= p[i] >= base + share
        enough &= ~own
        out = []
        for i, qid in enumerate(q_ids):
            near = np.flatnonzero(enough[i])
            score = sum(p[i, near] for p in parts)
            if cut[i] is not None:
                keep = score >= cut[i]
                near, score = near[keep], score[keep]
            order = np.lexsort((v_ids[near], -score))[:k] if kind is not object else sorted(
                range(len(near)), key=lambda j: (-score[j], v_ids[near[j]]))[:k]
            out += [(int(qid), int(v_ids[near[j]]), _long(score[j])) for j in order]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    final = paired(queries.join(bounds.hint("merge"), "id")).mapInArrow(resolve, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _long(x) -> int:
    return max(-LONG, min(LONG, int(x)))
