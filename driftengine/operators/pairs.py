"""Item pairs, pair distances, representatives and maps.

Nothing here emits the pairs of an unbounded set: co-occurrence is pruned by support, windowed
pairs are limited by the window, close pairs must share a segment, and the medoid, the selection and
the map are linear in the rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftengine.functions.columns import hamming_arrow, ratio
from driftengine.functions.tails import fisher_greater
from driftengine.scale import dim_join, hash_rank, is_small, materialize


def cooccurrence(
    df: DataFrame, record: str, item: str, min_share: float = 0.05, min_count: int = 5,
    with_p: bool = True,
) -> DataFrame:
    """Item pairs present in the same record: counts, odds ratio, one-sided Fisher p.

    Only items in at least max(min_count, min_share of the records) take part. Their number is
    at most (items per record) / min_share, which bounds the pairs of any record; pairs are
    counted map-side, so only one row per task and pair is shuffled.
    """
    incidence = df.where(F.col(record).isNotNull() & F.col(item).isNotNull()).select(record, item)
    records = incidence.select(record).distinct().agg(F.count(F.lit(1)).alias("n_records"))
    counts = incidence.distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(min_count), F.floor(F.col("n_records") * F.lit(min_share)))
    frequent = materialize(counts.join(F.broadcast(records)).where(F.col("n") >= need))  # one row
    # Rare items go before anything is shuffled by record; only the counts were written.
    kept = dim_join(incidence, frequent.select(item), [item], ready=True)
    sets = kept.groupBy(record).agg(F.sort_array(F.collect_set(item)).alias("s"))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(
        F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = sets.where(F.size("s") > 1).select(F.explode(pair).alias("p")).groupBy(
        F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n_both"))
    one = frequent.select(F.col(item).alias("a"), F.col("n").alias("n_a"), "n_records")
    two = frequent.select(F.col(item).alias("b"), F.col("n").alias("n_b"))
    t = dim_join(dim_join(both, one, ["a"], ready=True), two, ["b"], ready=True)
    only_a, only_b = F.col("n_a") - F.col("n_both"), F.col("n_b") - F.col("n_both")
    neither = F.col("n_records") - F.col("n_a") - F.col("n_b") + F.col("n_both")
    odds = ratio(F.col("n_both").cast("double") * neither, only_a.cast("double") * only_b)
    t = t.select("a", "b", "n_both", "n_a", "n_b", "n_records", odds.alias("odds_ratio"))
    if not with_p:
        return t
    return t.withColumn("p", fisher_greater("n_both", only_b, only_a, neither))


def _swept(batch: pa.RecordBatch, context: Sequence[str], w: int) -> pa.RecordBatch:
    """Counted pairs of events at most ``w`` positions apart, first one first, over the records of a batch.

    A record's events are sorted by position, so the partners of each are the ones right after it: the
    k-th after it is looked at for all events together, until none is near enough.
    """
    events = batch.column("events")
    n = np.asarray(pa.compute.list_value_length(events), np.int64)
    flat = events.flatten()
    position = flat.field("position").to_numpy(zero_copy_only=False).astype(np.int64)
    record = np.repeat(np.arange(len(n)), n)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    near, k = np.arange(len(position)), 1
    while len(near):
        near = near[near + k < len(position)]
        near = near[(record[near] == record[near + k]) & (position[near + k] - position[near] <= w)]
        # Several symbols at one position are not each other's neighbours.
        apart = near[position[near + k] != position[near]]
        first.append(apart)
        second.append(apart + k)
        k += 1
    i, j = pa.array(np.concatenate(first)), pa.array(np.concatenate(second))
    symbols = flat.field("var_char")
    columns = {c: batch.column(c).take(pa.array(record)).take(i) for c in context}
    columns |= {"position": flat.field("position").take(i), "var_char": symbols.take(i),
                "pos_j": flat.field("position").take(j), "var_j": symbols.take(j)}
    counted = pa.table(columns).group_by(list(columns)).aggregate([([], "count_all")])
    return counted.rename_columns([*columns, "c_ij"]).combine_chunks()


def npmi_score(
    events: DataFrame, w: int = 20, min_pairs: int = 50, top: int = 3,
    context: Sequence[str] = ("period",),
) -> DataFrame:
    """Association of a variant with its neighbours within ``w`` positions, per period, in [0, 1].

    Mean of the ``top`` normalised pointwise mutual informations; with fewer than ``min_pairs``
    pairs, distinct neighbours / w. Events are brought together by record once; a sweep over each
    record's sorted events finds the neighbours, and only pairs counted per batch are shuffled. A task
    holds the events of whole records, never those of a context.
    """
    context = list(context)
    key = ["position", "var_char"]
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    sets = events.groupBy(*context, "id").agg(F.sort_array(F.collect_set(F.struct(*key))).alias("events"))
    n_rec = sets.groupBy(*context).agg(F.count(F.lit(1)).alias("n"))
    single = sets.select(*context, F.explode("events").alias("e")).groupBy(
        *context, F.col("e.position").alias("position"), F.col("e.var_char").alias("var_char")).agg(F.count(F.lit(1)).alias("c"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _swept(batch, context, w).to_batches()

    pair = [("position", "position"), ("var_char", "var_char"), ("pos_j", "position"), ("var_j", "var_char")]
    schema = ", ".join([f"`{c}` {types[c]}" for c in context] + [f"{c} {types[t]}" for c, t in pair] + ["c_ij long"])
    one_way = sets.select(*context, "events").mapInArrow(sweep, schema).groupBy(
        *context, *[c for c, _ in pair]).agg(F.sum("c_ij").alias("c_ij"))
    back = one_way.select(*context, F.col("pos_j").alias("position"), F.col("var_j").alias("var_char"),
                          F.col("position").alias("pos_j"), F.col("var_char").alias("var_j"), "c_ij")
    cooc = materialize(one_way.unionByName(back))
    single = materialize(single)
    c_j = single.select(*context, F.col("position").alias("pos_j"), F.col("var_char").alias("var_j"),
                        F.col("c").alias("c_j"))
    c_i = single.withColumnRenamed("c", "c_i")
    n_rec = materialize(n_rec)
    t = dim_join(cooc.join(c_j, [*context, "pos_j", "var_j"]).join(c_i, [*context, *key]), n_rec,
                 context, ready=True)
    n = F.col("n").cast("double")
    p_i, p_j, p_ij = F.col("c_i") / n, F.col("c_j") / n, F.col("c_ij") / n
    # Fixed value: 1e-10 keeps the logarithms finite.
    tiny = F.lit(1e-10)
    pmi = F.log(p_ij / (p_i * p_j + tiny) + tiny) / (-F.log(p_ij + tiny))
    t = t.withColumn("npmi", pmi)
    order = Window.partitionBy(*context, *key).orderBy(F.col("npmi").desc(), "pos_j", "var_j")
    best = t.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= top)
    best = best.groupBy(*context, *key).agg(F.avg("npmi").alias("__mean"))
    totals = cooc.groupBy(*context, *key).agg(
        F.sum("c_ij").alias("n_pairs"), F.count(F.lit(1)).alias("n_neighbours"))
    out = single.join(totals, [*context, *key], "left").join(best, [*context, *key], "left")
    out = out.na.fill(0, ["n_pairs", "n_neighbours"])
    enough = F.col("n_pairs") >= min_pairs
    score = F.when(enough, F.least(F.greatest(F.col("__mean"), F.lit(0.0)), F.lit(1.0))).otherwise(
        F.least(F.col("n_neighbours") / F.lit(w), F.lit(1.0)))
    return out.select(
        *context, *key, F.col("c").alias("n_records"), "n_pairs", "n_neighbours",
        score.alias("score"), F.when(enough, "npmi").otherwise("fallback").alias("method"))


#: Segments that a pair of sequences must share, at most, and keys that a sequence may have then.
SHARED_SEGMENTS, SEGMENT_KEYS = 7, 64


def segment_meetings(d: DataFrame, limit: int, key: str, seq: str) -> DataFrame:
    """``id_a, __a, id_b, __b`` (``id_a < id_b``) of candidates of ``close_pairs`` among distinct sequences, each once."""
    shared = max(g for g in range(1, SHARED_SEGMENTS + 1) if g == 1 or math.comb(limit + g, g) <= SEGMENT_KEYS)
    n, parts = F.length(seq), limit + shared
    edge = lambda i: F.floor(n * F.lit(i) / F.lit(parts)).cast("int")
    cuts = [F.xxhash64(F.substring(F.col(seq), edge(i) + 1, edge(i + 1) - edge(i))).alias(f"__c{i}") for i in range(parts)]
    keys = F.array(*[F.xxhash64("__n", F.lit(i), *[F.col(f"__c{j}") for j in held])
                     for i, held in enumerate(itertools.combinations(range(parts), shared))])
    several = ["__keys"] if limit > 1 else []  # a pair that differs in one segment shares one key
    listed = d.select(F.col(key).alias("id"), F.col(seq).alias("s"), n.alias("__n"), *cuts).withColumn("__keys", keys)
    listed = listed.select("id", "s", *several, F.explode("__keys").alias("__h"))
    a, b = listed.alias("a"), listed.alias("b")
    met = a.join(b, (F.col("a.__h") == F.col("b.__h")) & (F.col("a.id") < F.col("b.id"))).where(F.length("a.s") == F.length("b.s"))
    if several:
        met = met.where(F.get(F.array_intersect("a.__keys", "b.__keys"), F.lit(0)) == F.col("a.__h"))
    return met.select(F.col("a.id").alias("id_a"), F.col("a.s").alias("__a"), F.col("b.id").alias("id_b"), F.col("b.s").alias("__b"))


def close_pairs(df: DataFrame, limit: int, key: str = "id", seq: str = "sequence") -> DataFrame:
    """Pairs ``id_a < id_b`` of sequences of one length that differ in at most ``limit`` positions.

    Equal sequences are represented by one; members of a class are at distance 0 of its id and are
    not listed as pairs. A sequence is cut into ``limit`` + g segments, of which a pair must share
    some g: candidates meet by length and the digest of any g segments, and a pair is kept at the first
    digest it shares. g is as large as ``SEGMENT_KEYS`` allows, so candidates agree in nearly all positions;
    with limit 1 and eight symbols at most they are the pairs themselves, however many sequences
    there are. Hot digests are split by AQE. For any limit; all pairs of a short list are those with
    the limit of its longest sequence.
    """
    d = materialize(df.where(F.col(seq).isNotNull()).groupBy(seq).agg(F.min(key).alias("id")))
    differ = F.size(F.filter(F.zip_with(F.split("__a", ""), F.split("__b", ""), lambda x, y: x != y), lambda x: x))
    return segment_meetings(d, limit, "id", seq).select("id_a", "id_b", differ.alias("distance")).where(
        F.col("distance") <= limit)


#: Positions of a block, texts that meet a block's counts in one task, symbols of a portion, and cells
#: (position and symbol) that a task counts before it sends them.
BLOCK, BLOCK_TEXTS, PORTION, CELLS = 512, 1 << 16, 1 << 20, 1 << 21
#: Bits of a symbol in a cell; the position is above them.
SYMBOL = 21


def _portions(texts: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """Texts or cuts of them, each with its first position, in lists of about ``PORTION`` symbols."""
    held, n = [], 0
    for t in texts:
        for at in range(0, len(t), PORTION):
            held.append((at, t[at:at + PORTION]))
            n += len(held[-1][1])
            if n >= PORTION:
                yield held
                held, n = [], 0
    if held:
        yield held


def _cells(texts: Sequence[tuple[int, str]]) -> np.ndarray:
    """The cell of every symbol of texts that begin at the given positions."""
    lens = np.array([len(t) for _, t in texts], np.int64)
    symbols = np.frombuffer("".join(t for _, t in texts).encode("utf-32-le"), np.uint32)
    before = np.cumsum(lens) - lens - np.array([at for at, _ in texts], np.int64)
    return (np.arange(len(symbols)) - np.repeat(before, lens)) << SYMBOL | symbols.astype(np.int64)


def _added(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their counts, added up."""
    cells, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], n[order]
    new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[new], np.add.reduceat(n, new)


def _block_counts(d: DataFrame, group: str, seq: str) -> DataFrame:
    """``group, block, texts, cells, w``: of each block of positions how many texts reach it, its cells in
    order, and for each the rows with that symbol there plus the rows that reach the position.

    A task sends the counts of its texts, not their symbols; those of a block are added up as they come.
    """
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}

    def batch_of(rows: list[tuple], names: Sequence[str], like: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], like if i == 0 else None) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        like = None

        def send() -> Iterator[pa.RecordBatch]:
            for g, parts in held.items():
                cells, n = _added(parts)
                block = (cells >> SYMBOL) // BLOCK
                cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(cells)]
                for i in range(0, len(cuts) - 1, 64):
                    rows = [(g, int(block[a]), cells[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[i:i + 64], cuts[i + 1:i + 65])]
                    yield batch_of(rows, (group, "block", "cells", "n"), like)
            held.clear()

        for batch in batches:
            like, by = batch.column(group).type, {}
            for g, t in zip(batch.column(group).to_pylist(), batch.column(seq).to_pylist()):
                by.setdefault(g, []).append(t)
            for g, texts in by.items():
                for portion in _portions(texts):
                    held.setdefault(g, []).append(np.unique(_cells(portion), return_counts=True))
                    if len(held[g]) > 4:
                        held[g] = [_added(held[g])]
            if sum(len(c) for parts in held.values() for c, _ in parts) > CELLS:
                yield from send()
        yield from send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, like = None, [], None

        def block_row() -> pa.RecordBatch:
            cells, n = _added(parts)
            position = cells >> SYMBOL
            first = np.flatnonzero(np.append(True, position[1:] != position[:-1]))
            reach = np.add.reduceat(n, first)
            w = n + np.repeat(reach, np.diff(first, append=len(n)))
            return batch_of([(*now, int(reach[0]), cells.tobytes(), w.tobytes())], (group, "block", "texts", "cells", "w"), like)

        for batch in batches:
            like = batch.column(group).type
            for g, block, cells, n in zip(*(batch.column(c).to_pylist() for c in (group, "block", "cells", "n"))):
                if parts and (g, block) != now:
                    yield block_row()
                    parts = []
                now = g, block
                parts.append((np.frombuffer(cells, np.int64), np.frombuffer(n, np.int64)))
                if len(parts) > 8:
                    parts = [_added(parts)]
        if parts:
            yield block_row()

    sent = d.select(group, seq).mapInArrow(count, f"`{group}` {types[group]}, block long, cells binary, n binary")
    ordered = sent.repartition(group, "block").sortWithinPartitions(group, "block")
    return ordered.mapInArrow(add, f"`{group}` {types[group]}, block long, texts long, cells binary, w binary")


def _scored(d: DataFrame, counts: DataFrame, group: str, seq: str) -> DataFrame:
    """``id, group, n, w`` of pieces of all texts: their symbols and the sum of ``w`` over their cells.

    Texts are cut into blocks of positions, which meet their block's counts; a block that many texts reach
    is dealt over several tasks, each with the counts.
    """
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    piece = f"id {types['id']}, `{group}` {types[group]}, block long, piece string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(seq).to_pylist()
            starts = [range(0, max(1, len(t)), BLOCK) for t in texts]
            of = pa.array(np.repeat(np.arange(len(texts)), [len(r) for r in starts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(of), batch.column(group).take(of), pa.array([at // BLOCK for r in starts for at in r], pa.int64()),
                 pa.array([t[at:at + BLOCK] for t, r in zip(texts, starts) for at in r], pa.string())],
                names=["id", group, "block", "piece"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = w = np.zeros(0, np.int64)
        for batch in batches:
            counted = np.flatnonzero(np.asarray(batch.column("cells").is_valid())).tolist()
            for a, b in itertools.pairwise([0, *counted, batch.num_rows]):
                if a < b and batch.column("cells")[a].is_valid:
                    cells, w = (np.frombuffer(batch.column(c)[a].as_buffer(), np.int64) for c in ("cells", "w"))
                    a += 1
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                blocks, texts = part.column("block").to_pylist(), part.column("piece").to_pylist()
                n = np.array([len(t) for t in texts], np.int64)
                mine = _cells([(BLOCK * i, t) for i, t in zip(blocks, texts)])
                upto = np.concatenate([[0], np.cumsum(w[np.searchsorted(cells, mine)])])
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column(group), pa.array(n), pa.array(upto[ends] - upto[ends - n])],
                                                 names=["id", group, "n", "w"])

    pieces = d.select("id", group, seq).mapInArrow(cut, piece)
    deals = F.ceil(F.col("texts") / F.lit(BLOCK_TEXTS)).cast("int")
    wide = counts.where(F.col("texts") > BLOCK_TEXTS).select(group, "block", deals.alias("deals"))
    pieces = dim_join(pieces, wide, [group, "block"], "left").select(
        group, "block", F.pmod(F.xxhash64("piece", "id"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"), "id", "piece",
        F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("binary").alias("w"))
    sent = counts.select(group, "block", F.explode(F.sequence(F.lit(0), F.greatest(deals, F.lit(1)) - 1)).alias("deal"),
                         F.lit(None).cast(types["id"]).alias("id"), F.lit(None).cast("string").alias("piece"), "cells", "w")
    # A block's counts come before its pieces; only pieces of empty texts may come without any.
    ordered = sent.unionByName(pieces).repartition(group, "block", "deal").sortWithinPartitions(
        group, "block", "deal", F.col("cells").isNull())
    return ordered.mapInArrow(score, f"id {types['id']}, `{group}` {types[group]}, n long, w long")


def medoid(df: DataFrame, group: str = "grp", seq: str = "sequence") -> DataFrame:
    """Per group the row with the smallest mean number of differing positions to all rows (a
    length difference counts), smallest id on ties. No pairs are formed.

    With N rows, c rows sharing a symbol at a position, l rows reaching that position and T
    symbols in the group, the sum over all rows is T + sum over own positions of (N - c - l). Symbols are
    counted in tasks and looked up there, by blocks of positions; none of them becomes a row.
    """
    d = df.where(F.col(seq).isNotNull() & F.col(group).isNotNull()).select("id", group, seq)
    sizes = d.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(seq)).alias("n_symbols"))
    sizes = materialize(sizes)
    counts = materialize(_block_counts(d, group, seq))
    own = _scored(d, counts, group, seq).groupBy("id", group).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    own = dim_join(own, sizes, [group], ready=True).withColumn("v", F.col("n_rows") * F.col("n") - F.col("w"))
    best = own.groupBy(group).agg(F.min(F.struct("v", "id")).alias("m"))
    return best.join(sizes, group).select(
        group, F.col("m.id").alias("id"), ((F.col("n_symbols") + F.col("m.v")) / F.col("n_rows")).alias("mean_distance"))


def _codes(texts: Sequence[str], width: int | None = None) -> np.ndarray:
    """Texts as a code-point matrix, short rows padded with a value no symbol has."""
    arrays = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
    out = np.full((len(arrays), width or max((len(a) for a in arrays), default=0)), 2**32 - 1, np.uint32)
    for i, a in enumerate(arrays):
        n = min(len(a), out.shape[1])
        out[i, :n] = a[:n]
    return out


def _to_rows(text: str, codes: np.ndarray, lens: np.ndarray, empty: float | None = None) -> np.ndarray:
    """Share of differing positions to each coded text; without a common position ``empty``, or whether
    the lengths differ."""
    own = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    m = min(len(own), codes.shape[1])
    short = np.minimum(lens, len(own))
    inside = np.arange(m) < short[:, None]
    mismatch = ((codes[:, :m] != own[:m]) & inside).sum(axis=1)
    nothing = 1.0 * (lens != len(own)) if empty is None else empty
    return np.where(short > 0, mismatch / np.maximum(short, 1), nothing)


def _matrix(texts: Sequence[str]) -> np.ndarray:
    """Share of differing positions over the shared prefix, every pair."""
    codes, lens = _codes(texts), np.array([len(t) for t in texts])
    return np.array([_to_rows(t, codes, lens) for t in texts])


#: Rows of a group that stay in the running between two passes over all rows.
POOL = 32
#: Texts of picks go to all tasks if they were measured to have no more characters than this.
PICK_CHARS = 8 << 20


def _nearest(rows: DataFrame, picks: DataFrame, group: str, key: str, seq: str) -> DataFrame:
    """``group, key, __d``: distance of every row that is no pick to the nearest pick of its group."""
    grown = picks.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pick", F.col(key).alias("k"), F.col(seq).alias("s")))).alias("__p"))
    held, most = grown.agg(F.sum(F.expr("aggregate(__p, 0L, (n, p) -> n + length(p.s))")), F.max(F.size("__p"))).first()
    taken = F.exists("__p", lambda p: p["k"] == F.col(key))
    if held <= PICK_CHARS:
        texts = rows.sparkSession.sparkContext.broadcast({r[0]: [p.s for p in r["__p"]] for r in grown.collect()})

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codes = {g: (_codes(p), np.array([len(t) for t in p])) for g, p in texts.value.items()}
            for pdf in batches:
                d = [float(_to_rows(t, *codes[g], empty=1.0).min()) for g, t in zip(pdf[group], pdf[seq])]
                yield pdf[[group, key]].assign(__d=d)

        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        mine = dim_join(rows.select(group, key, seq), grown.select(group, F.transform("__p", lambda p: p["k"]).alias("__p")), [group])
        mine = mine.where(~F.array_contains("__p", F.col(key))).drop("__p")
        return mine.mapInPandas(work, f"`{group}` {types[group]}, `{key}` {types[key]}, __d double")
    near = dim_join(rows.select(group, key, seq), grown, [group])
    to = [F.when(F.size("__p") > i, hamming_arrow(F.col(seq), F.coalesce(F.get("__p", F.lit(i))["s"], F.lit(""))))
          for i in range(most)]
    return near.where(~taken).select(group, key, (F.least(*to) if most > 1 else to[0]).alias("__d"))


def diverse_select(
    df: DataFrame, group: str, quota: int, key: str = "id", seq: str = "sequence"
) -> DataFrame:
    """Up to ``quota`` mutually distant rows per group by farthest-point selection over all rows.

    The first pick is the group's ``medoid``; each further one is the row farthest from its nearest
    pick, the smallest key on ties. Adds ``pick`` (1, 2, ... in order of selection). Rows with a null
    sequence take no part.

    A pass over all rows gives each its distance to the nearest pick. The ``POOL`` farthest rows of a
    group go on picking among themselves: distances only fall as picks are added, so the best of them
    is the best of all as long as it beats what the best row outside had in the pass. Then the next
    pass is due. The result is the same as with a pass for every pick.
    """
    rows = df.where(F.col(seq).isNotNull())
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    first = medoid(rows.select(F.col(key).alias("id"), group, seq), group, seq).select(
        F.col("id").alias(key), group)
    picks = materialize(dim_join(rows, first, [group, key]).select(
        group, key, seq, F.lit(1).alias("pick")).dropDuplicates([group]))
    sizes = materialize(rows.groupBy(group).agg(F.least(F.countDistinct(key), F.lit(quota)).alias("__goal")))
    order = Window.partitionBy(group).orderBy(F.desc("__d"), key)
    schema = f"`{group}` {types[group]}, `{key}` {types[key]}, `{seq}` string, pick int"

    def go_on(pool: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({group: [], key: [], seq: [], "pick": []}).astype({"pick": "int32"})
        if pool.empty or before.empty:
            return empty
        pool = pool.sort_values("__rn")
        outside = pool[pool["__rn"] > POOL]
        inside = pool[pool["__rn"] <= POOL].drop_duplicates(key)
        texts, keys, d = list(inside[seq]), list(inside[key]), inside["__d"].to_numpy(float).copy()
        codes, lens = _codes(texts), np.array([len(t) for t in texts])
        goal, n, out, left = int(before["__goal"].iloc[0]), len(before), [], set(range(len(texts)))
        while left and n < goal:
            best = min(left, key=lambda i: (-d[i], keys[i]))
            if len(outside) and (-d[best], keys[best]) > (-outside["__d"].iloc[0], outside[key].iloc[0]):
                break
            n += 1
            out.append((pool[group].iloc[0], keys[best], texts[best], n))
            left.discard(best)
            d = np.minimum(d, _to_rows(texts[best], codes, lens, empty=1.0))
        return pd.DataFrame(out, columns=[group, key, seq, "pick"]) if out else empty

    while True:
        counted = picks.join(sizes, group).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group)))
        todo = materialize(counted.where("__n < __goal").drop("__n"))
        if todo.isEmpty():
            break
        far = _nearest(rows, todo, group, key, seq).withColumn("__rn", F.row_number().over(order))
        far = materialize(far.where(F.col("__rn") <= POOL + 1))
        pool = dim_join(rows.select(group, key, seq), far, [group, key], ready=True)
        before = todo.select(F.col(group).alias("__group"), "__goal")
        more = pool.groupBy(group).cogroup(before.groupBy("__group")).applyInPandas(go_on, schema)
        picks = materialize(picks.unionByName(more))
    return df.join(F.broadcast(picks.select(group, key, "pick")) if is_small(picks) else picks.select(
        group, key, "pick"), [group, key])


#: Longest sequence that may be a landmark, and rows that landmarks are chosen from, for each of them:
#: the driver holds no more symbols than their product with the landmarks' number.
LANDMARK_CHARS, CHOICE = 1 << 14, 4
#: Majorisation steps of the landmarks' map and of a placed row.
MAP_STEPS, PLACE_STEPS = 200, 25


def _farthest(dist: np.ndarray, n: int) -> list[int]:
    """``n`` mutually far rows of a distance matrix, from the one farthest from all."""
    picks = [int(dist.sum(axis=1).argmax())]
    near = dist[picks[0]].copy()
    while len(picks) < min(n, len(dist)):
        near[picks] = -1
        picks.append(int(near.argmax()))
        near = np.minimum(near, dist[picks[-1]])
    return sorted(picks)


def _pulled(xy: np.ndarray, marks: np.ndarray, d: np.ndarray, steps: int) -> np.ndarray:
    """Points (n x 2) moved by majorisation towards distances ``d`` (n x landmarks); stress never rises."""
    for _ in range(steps):
        apart = xy[:, None, :] - marks[None]
        away = np.sqrt((apart**2).sum(axis=2))
        xy = (marks[None] + (d / np.maximum(away, 1e-12))[:, :, None] * apart).mean(axis=1)
    return xy


def _majorised(xy: np.ndarray, dist: np.ndarray, steps: int) -> np.ndarray:
    """Landmark coordinates whose distances fit ``dist`` (Guttman transforms; stress never rises)."""
    n = len(xy)
    for _ in range(steps):
        away = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
        share = -np.where(away > 1e-12, dist / np.maximum(away, 1e-12), 0.0)
        np.fill_diagonal(share, 0.0)
        np.fill_diagonal(share, -share.sum(axis=1))
        moved = share @ xy / n
        if np.abs(moved - xy).max() < 1e-9:
            break
        xy = moved
    return xy


def landmark_map(
    df: DataFrame, n_landmarks: int = 100, key: str = "id", seq: str = "sequence", seed: int = 42
) -> DataFrame:
    """2-D coordinates of every row from its distances to a few landmark rows.

    Landmarks are mutually far rows among the first in hash order (``CHOICE`` for each; sequences over
    ``LANDMARK_CHARS`` are placed but are no landmarks). Their own map starts from classical scaling
    and is improved by stress majorisation, on matrices of their number squared. Each row is placed by
    triangulation and moved by majorisation, a batch at a time. ``err2`` and ``d2`` are its sums of
    squared residuals and distances, see ``map_stress``. Null sequences take no part.
    """
    rest = df.where(F.col(seq).isNotNull())
    fields = [f for f in rest.schema.fields if f.name != seq]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", x double, y double, err2 double, d2 double"
    marks = hash_rank(rest.where(F.length(seq) <= LANDMARK_CHARS), [], key, seed, CHOICE * n_landmarks).select(key, seq)
    texts = [r[1] for r in marks.orderBy(key).collect()]  # CHOICE * n_landmarks rows of bounded length
    if not texts:
        texts = [""]
    dist = _matrix(texts)
    chosen = _farthest(dist, n_landmarks)
    texts, dist = [texts[i] for i in chosen], dist[np.ix_(chosen, chosen)]
    sq, n = dist**2, len(texts)
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ sq @ centre)
    top = np.argsort(values)[::-1][:2]
    scale = np.sqrt(np.maximum(values[top], 1e-12))
    signs = np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top])
    flat = np.zeros((n, 2))
    flat[:, :len(top)] = vectors[:, top] * scale * signs
    place = np.zeros((2, n))
    place[:len(top)] = (vectors[:, top] * signs / scale).T
    where = _majorised(flat, dist, MAP_STEPS)
    mean_sq = sq.mean(axis=1)
    codes, lens = _codes(texts), np.array([len(t) for t in texts])

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                pdf = whole.iloc[i:i + 1024]
                d = np.array([_to_rows(t, codes, lens) for t in pdf[seq]])
                xy = _pulled(-0.5 * (d**2 - mean_sq) @ place.T, where, d, PLACE_STEPS)
                gap = np.sqrt(((xy[:, None] - where[None]) ** 2).sum(axis=2)) - d
                got = pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "err2": (gap**2).sum(axis=1), "d2": (d**2).sum(axis=1)})
                yield pd.concat([pdf.drop(columns=[seq]).reset_index(drop=True), got], axis=1)

    return rest.mapInPandas(locate, schema)


def map_stress(mapped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Kruskal stress-1 of the map over all (row, landmark) pairs."""
    return mapped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(ratio(F.sum("err2"), F.sum("d2"))).alias("stress"))
