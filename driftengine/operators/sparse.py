"""Principal components of sparse tables: one row per (row, term) that is not zero.

The table is never dense. The components' subspace is found by randomized subspace iteration: a block of
vectors over the terms is multiplied by the centred table and by its transpose and made orthonormal from
its inner products. The table is kept packed, a record a row, so a round is one pass over it. A block
that was measured to be small goes to every task, which sends back one sum a term; a larger one stays
distributed and is joined with the entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.scale import BROADCAST_MAX_BYTES, dim_join, materialize, written

#: Vectors of the block beyond the components asked for; they let the last components settle.
EXTRA = 8
#: Rounds at most, and the relative change of the explained variance that ends them earlier.
ROUNDS, SETTLED = 25, 1e-5
#: Entries that are multiplied at once.
STRETCH = 1 << 16


def term_moments(entries: DataFrame, n_rows: int, term: str = "kmer", value: str = "freq") -> DataFrame:
    """``term, mean, variance`` over all rows, those without the term as zeros (sample variance)."""
    t = entries.groupBy(term).agg(F.sum(F.col(value).cast("double")).alias("s"),
                                  F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    mean = F.col("s") / F.lit(float(n_rows))
    return t.select(F.col(term).alias("term"), mean.alias("mean"), F.greatest(
        F.try_divide(F.col("q") - F.col("s") * mean, F.lit(n_rows - 1.0)), F.lit(0.0)).alias("variance"))


def total_variance(entries: DataFrame, n_rows: int, term: str = "kmer", value: str = "freq") -> DataFrame:
    """One row ``n_terms, total_variance``: the trace of the covariance."""
    return term_moments(entries, n_rows, term, value).agg(
        F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("variance"), F.lit(0.0)).alias("total_variance"))


def _products(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Inner products of columns: sums in tasks, then per cell of the (small) matrix."""
    r = len(cols)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((r, r))
        for pdf in batches:
            m = pdf.to_numpy(float)
            total += m.T @ m
        i, j = np.indices((r, r))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    cells = df.select(*cols).mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((r, r))
    for c in cells.collect():  # r x r
        out[c.i, c.j] = c.v
    return out


def _rotate(df: DataFrame, keep: Sequence[str], cols: Sequence[str], m: np.ndarray, out: Sequence[str]) -> DataFrame:
    """Columns times a small matrix."""
    mixed = [sum((F.col(c) * F.lit(float(w)) for c, w in zip(cols, column)), F.lit(0.0)).alias(o) for o, column in zip(out, m.T)]
    return df.select(*keep, *mixed)


def _packed(entries: DataFrame) -> tuple[DataFrame, int]:
    """``row, terms, values``: a record a row of the table, stored, and their number. Neighbouring entries of
    a row are packed where they are; rows that turn out to be in pieces are brought together."""
    types = {f.name: f.dataType.simpleString() for f in entries.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            at = pa.array(cuts, pa.int32())
            term, value = (pa.ListArray.from_arrays(at, t.column(c).combine_chunks()) for c in ("term", "v"))
            return pa.RecordBatch.from_arrays([t.column("row").combine_chunks().take(at[:-1]), term, value],
                                              names=["row", "terms", "values"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            row = t.column("row").combine_chunks()
            cuts = np.flatnonzero(pc.not_equal(row[1:], row[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(cuts):  # the last row may go on in the next batch
                yield lists(t.slice(0, cuts[-1]), np.append(0, cuts))
                t = t.slice(cuts[-1])
            held = t
        if held is not None:
            yield lists(held, np.array([0, held.num_rows]))

    rows = written(entries.mapInArrow(pack, f"row {types['row']}, terms array<{types['term']}>, values array<double>"), "packed")
    n, pieces = rows.select("row").distinct().count(), rows.count()
    if n < pieces:
        piece = F.collect_list(F.struct("terms", "values")).alias("p")
        rows = written(rows.groupBy("row").agg(piece).select(
            "row", *[F.flatten(f"p.{c}").alias(c) for c in ("terms", "values")]), "packed")
    return rows, n


def _listed(rows: DataFrame) -> DataFrame:
    """The entries of packed rows: ``row, term, v``."""
    pair = F.explode(F.arrays_zip("terms", "values")).alias("e")
    return rows.select("row", pair).select("row", F.col("e.terms").alias("term"), F.col("e.values").alias("v"))


def _numbered(rows: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Packed rows with ``ids``, places in the vocabulary, instead of terms, stored; other terms are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = batch.column("terms")
            ids = pc.index_in(term.flatten(), value_set=shared.value)
            known = ids.is_valid()
            n = np.asarray(pc.list_value_length(term), np.int64)
            kept = np.bincount(np.repeat(np.arange(len(n)), n)[known.to_numpy(zero_copy_only=False)], minlength=len(n))
            some = pa.array(np.flatnonzero(kept))
            at = pa.array(np.append(0, np.cumsum(kept[kept > 0])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(some), pa.ListArray.from_arrays(at, ids.filter(known)),
                 pa.ListArray.from_arrays(at, batch.column("values").flatten().filter(known))], names=["row", "ids", "values"])

    kind = rows.schema["row"].dataType.simpleString()
    return written(rows.select("row", "terms", "values").mapInArrow(number, f"row {kind}, ids array<int>, values array<double>"), "numbered")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last row, lengths, ids and values of about ``STRETCH`` entries of packed rows at a time."""
    n = np.asarray(pc.list_value_length(batch.column("ids")), np.int64)
    ids, values = (np.asarray(batch.column(c).flatten()) for c in ("ids", "values"))
    upto, at = np.append(0, np.cumsum(n)), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + STRETCH, "right")) - 1)
        yield at, to, n[at:to], ids[upto[at]:upto[to]], values[upto[at]:upto[to]]
        at = to


def _row_sums(block: np.ndarray, n: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Packed rows times a block (vectors x terms): vectors x rows. No row is empty."""
    first = np.cumsum(n) - n
    return np.stack([np.add.reduceat(vector[ids] * values, first) for vector in block])


def _term_sums(rows: DataFrame, block: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With Z = rows x ``block`` - ``centre``: rows' x Z (vectors x terms) and Z' x Z. One pass; a task sends
    one sum a term."""
    r, n_terms = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, inner = np.zeros((r, n_terms)), np.zeros((r, r))
        seen = np.zeros(n_terms, bool)
        for batch in batches:
            for _, _, n, ids, values in _stretches(batch):
                z = _row_sums(shared.value, n, ids, values) - centre[:, None]
                inner += z @ z.T
                seen[ids] = True
                for j in range(r):
                    total[j] += np.bincount(ids, np.repeat(z[j], n) * values, n_terms)
        # The inner products go along as terms below zero.
        which = np.flatnonzero(seen)
        sums = np.concatenate([total[:, which], inner], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([which, -1 - np.arange(r)]).astype(np.int32)), *map(pa.array, sums)],
            names=["term", *[f"s{j}" for j in range(r)]])

    names = [f"s{j}" for j in range(r)]
    parts = rows.select("ids", "values").mapInArrow(work, "term int, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # the block's size
    term, sums = np.asarray(got.column("term")), np.stack([np.asarray(got.column(c)) for c in names])
    more, inner = np.zeros((r, n_terms)), np.zeros((r, r))
    more[:, term[term >= 0]] = sums[:, term >= 0]
    inner[:, -1 - term[term < 0]] = sums[:, term < 0]
    shared.destroy()
    return more, inner


def _scores(rows: DataFrame, block: np.ndarray, centre: np.ndarray) -> DataFrame:
    """``row, pca``: packed rows times a block, less ``centre``."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, n, ids, values in _stretches(batch):
                z = _row_sums(shared.value, n, ids, values) - centre[:, None]
                ends = pa.array(np.arange(to - at + 1) * len(centre), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, to - at), pa.ListArray.from_arrays(ends, pa.array(z.T.ravel()))], names=["row", "pca"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "ids", "values").mapInArrow(work, f"row {kind}, pca array<double>")


def _subspace(block, n_components: int, n_terms: int, products: Callable, turned: Callable, multiply: Callable):
    """Rounds of subspace iteration from ``block``: eigenvalues of the covariance in the block's span, falling,
    their vectors, and what ``multiply`` gave of the last block.

    ``products(block)`` are inner products of its vectors, ``turned(block, m)`` are these times a small matrix,
    ``multiply(block)`` are the covariance in its span, a function that gives the next block, and anything."""
    before = None
    for _ in range(ROUNDS):
        # Orthonormal vectors with the same span; directions lost to rounding are dropped.
        values, vectors = np.linalg.eigh(products(block))
        good = values > values[-1] * 1e-14
        block = turned(block, vectors[:, good] / np.sqrt(values[good]))
        inner, grown, rest = multiply(block)
        found, turn = np.linalg.eigh(inner)
        found, turn = found[::-1], turn[:, ::-1]
        top = found[:n_components].sum()
        if before is not None and abs(top - before) <= SETTLED * top or good.sum() == n_terms:
            break
        before = top
        block = grown()
    return found, turn, rest


def sparse_pca(
    entries: DataFrame, n_components: int = 16, key: str = "id", term: str = "kmer", value: str = "freq",
    n_rows: int | None = None, scale: bool = True, share: float = 0.95, seed: int = 42,
    block_bytes: int = BROADCAST_MAX_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Scores ``key, pca`` (array) of every row with an entry, and the table ``component, explained,
    cumulative, kept``; components are kept up to ``share`` of the whole variance.

    ``entries`` has at most one value a (row, term); ``n_rows`` counts rows without any entry too (by
    default there are none). With ``scale`` terms have unit variance. Terms without variance take no
    part. A component's sign is arbitrary. Fewer components come back where there are fewer. A block of
    more than ``block_bytes``, terms included, is not sent to tasks. The result is the same.
    """
    entries = entries.where(F.col(key).isNotNull() & F.col(term).isNotNull() & F.col(value).isNotNull()).select(
        F.col(key).alias("row"), F.col(term).alias("term"), F.col(value).cast("double").alias("v"))
    spark = entries.sparkSession
    row_type = entries.schema["row"].dataType.simpleString()
    packed, with_entries = _packed(entries)
    n_rows = with_entries if n_rows is None else n_rows
    entries = _listed(packed)
    weight = 1 / F.sqrt("variance") if scale else F.lit(1.0)
    terms = materialize(term_moments(entries, max(n_rows, 2), "term", "v").where("variance > 1e-300").select(
        "term", (F.col("mean") * weight).alias("c"), weight.alias("w"), "variance"))
    n_terms, whole, held = terms.agg(F.count(F.lit(1)), F.sum(F.lit(1.0) if scale else F.col("variance")), F.coalesce(
        F.sum(F.octet_length(F.col("term").cast("string"))), F.lit(0))).first()
    r = min(n_components + EXTRA, n_terms, max(n_rows - 1, 0))
    if r == 0:
        return (spark.createDataFrame([], f"{key} {row_type}, pca array<double>"),
                spark.createDataFrame([], "component int, explained double, cumulative double, kept boolean"))
    q = [f"q{j}" for j in range(r)]
    start = [((F.pmod(F.xxhash64("term", F.lit(seed + j)), F.lit(1 << 20)) / (1 << 19)) - 1).alias(c) for j, c in enumerate(q)]
    block = terms.select("term", "c", "w", *start)
    absent = n_rows - with_entries

    def covariance(inner: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return (inner + absent * np.outer(centre, centre)) / max(n_rows - 1, 1)  # rows without entries have -centre

    if n_terms * (r + 2) * 8 + held <= block_bytes:
        known = block.toArrow()
        c, w = (np.asarray(known.column(x)) for x in ("c", "w"))
        rows = _numbered(packed, known.column("term").combine_chunks())

        def multiply(b: np.ndarray):
            centre = b @ c
            more, inner = _term_sums(rows, b * w, centre)
            return covariance(inner, centre), lambda: more * w, (b * w, centre)

        found, turn, (last, centre) = _subspace(
            np.stack([np.asarray(known.column(x)) for x in q]), n_components, n_terms,
            lambda b: b @ b.T, lambda b, m: m.T @ b, multiply)
        turn = turn[:, :n_components]
        scores = _scores(rows, turn.T @ last, turn.T @ centre).withColumnRenamed("row", key)
    else:
        found, turn, (rows, z) = _joined_subspace(entries, block, q, n_components, n_terms, covariance)
        turn = turn[:, :n_components]
        names = [f"p{j}" for j in range(turn.shape[1])]
        scores = _rotate(rows, ["row"], z, turn, names).select(F.col("row").alias(key), F.array(*names).alias("pca"))
    explained = np.maximum(found[:n_components], 0) / whole
    upto = np.cumsum(explained)
    table = [(i + 1, float(e), float(c), bool(c - e < share)) for i, (e, c) in enumerate(zip(explained, upto))]
    return scores, spark.createDataFrame(table, "component int, explained double, cumulative double, kept boolean")


def _joined_subspace(
    entries: DataFrame, block: DataFrame, q: list[str], n_components: int, n_terms: int, covariance: Callable,
):
    """``_subspace`` with a distributed block (term, c, w and a column a vector): the products are joins with the
    entries and sums."""
    weighted = materialize(dim_join(entries, block.select("term", "w"), ["term"], ready=True).select(
        "row", "term", (F.col("v") * F.col("w")).alias("a")))

    def columns(b: DataFrame) -> list[str]:
        return b.columns[2:]

    def turned(b: DataFrame, m: np.ndarray) -> DataFrame:
        return materialize(_rotate(b, ["term", "c"], columns(b), m, q[:m.shape[1]]))

    def multiply(b: DataFrame):
        q = columns(b)
        z = [f"z{j}" for j in range(len(q))]
        centre = b.agg(*[F.sum(F.col("c") * F.col(x)).alias(x) for x in q]).first()
        rows = materialize(dim_join(weighted, b, ["term"], ready=True).groupBy("row").agg(
            *[(F.sum(F.col("a") * F.col(x)) - F.lit(float(centre[x]))).alias(y) for x, y in zip(q, z)]))

        def grown() -> DataFrame:
            return materialize(dim_join(weighted, rows, ["row"], ready=True).groupBy("term").agg(
                *[F.sum(F.col("a") * F.col(x)).alias(y) for x, y in zip(z, q)]).join(
                    b.select("term", "c"), "term").select("term", "c", *q))

        return covariance(_products(rows, z), np.array([centre[x] for x in q])), grown, (rows, z)

    return _subspace(materialize(block.drop("w")), n_components, n_terms, lambda b: _products(b, columns(b)), turned, multiply)
