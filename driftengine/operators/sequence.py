"""Reference choice, distances to it, position differences and positional statistics.

Records have ``id, grp, period, sequence``. Positions are 0-based.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.functions.columns import (
    alphabet_coverage,
    chars,
    hamming,
    hamming_arrow,
    ratio,
    symbol_fraction,
)
from driftengine.functions.tails import chi2_sf
from driftengine.scale import dim_join, exact_quantiles, materialize, order_rank, range_join

VARIANT = ["grp", "position", "ref_char", "var_char"]
#: Symbols whose k-mers are counted together.
KMER_SYMBOLS = 2_000_000


def modal_reference(
    df: DataFrame, group: str = "grp", where: Column | None = None, seq: str = "sequence"
) -> DataFrame:
    """Most frequent sequence per group: ``group, ref, n_ref, ref_length``.

    Ties go to the smallest md5 digest. With ``where`` only matching rows vote, unless a group
    has none. Votes are counted on the 16-byte digest and one digest per group wins, so texts
    are never shuffled for the count, however many are tied.
    """
    d = df.where(F.col(seq).isNotNull()).withColumn("__h", F.unhex(F.md5(seq)))
    voting = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    counts = d.groupBy(group, "__h").agg(
        F.sum(voting.cast("long")).alias("w"), F.count(F.lit(1)).alias("a"))
    w, a = F.col("w"), F.col("a")
    first = F.struct((-w).alias("w"), F.when(w > 0, F.lit(0)).otherwise(-a).alias("a"), F.col("__h").alias("h"))
    winners = counts.groupBy(group).agg(F.min(first).alias("b")).select(
        group, F.col("b.h").alias("__h"), (-F.col("b.w") - F.col("b.a")).alias("n_ref"))
    copies = dim_join(d.select(group, "__h", seq), winners, [group, "__h"])
    return copies.groupBy(group, "n_ref").agg(F.min(seq).alias("ref")).select(
        group, "ref", "n_ref", F.length("ref").alias("ref_length"))


def distance_to_reference(
    df: DataFrame,
    ref: DataFrame,
    group: str = "grp",
    seq: str = "sequence",
    long_texts: bool = True,
    **options,
) -> DataFrame:
    """``distance`` of every row to its group's reference, in units of the reference length."""
    h = hamming_arrow if long_texts else hamming
    joined = dim_join(df, ref, [group])
    return joined.withColumn(
        "distance", h(F.col(seq), F.col("ref"), **options) * F.col("ref_length")
    ).drop("ref")


def lineage_filter(df: DataFrame, max_distance: float, start: int) -> DataFrame:
    """Rows near the reference from a start period on."""
    return df.where((F.col("distance") < max_distance) & (F.col("period") >= start))


def diff_events(
    df: DataFrame, ref: DataFrame, keep: Sequence[str] = ("id", "grp", "period"),
    group: str = "grp", seq: str = "sequence",
) -> DataFrame:
    """One row per position where a sequence differs from its reference (shared prefix).

    Row-local: no shuffle unless the references are too many to broadcast.
    """
    joined = dim_join(df, ref.select(group, "ref"), [group])
    pairs = F.arrays_zip(F.split(seq, "").alias("v"), F.split("ref", "").alias("r"))
    # The outer form avoids a second evaluation of the arrays by the inferred size filter.
    # Past the shared prefix one side is null, so the comparison drops it; an empty text
    # splits into one empty symbol.
    long = joined.select(*keep, F.posexplode_outer(pairs).alias("position", "__e"))
    v, r = F.col("__e.v"), F.col("__e.r")
    return long.where((v != r) & (v != "") & (r != "")).select(
        *keep, "position", r.alias("ref_char"), v.alias("var_char")
    )


def symbol_counts(
    df: DataFrame, group: Sequence[str] = ("grp",), seq: str = "sequence", alphabet: str | None = None
) -> DataFrame:
    """Counts of each symbol at each position; combined map-side before the one shuffle."""
    long = df.select(*group, F.posexplode_outer(F.split(seq, "")).alias("position", "symbol"))
    long = long.where(F.col("symbol") != "")
    if alphabet:
        long = long.where(F.col("symbol").isin(list(alphabet)))
    return long.groupBy(*group, "position", "symbol").agg(F.count(F.lit(1)).alias("n"))


def position_rate(df: DataFrame, ref: DataFrame, group: str = "grp") -> DataFrame:
    """Share of a group's rows that differ at each reference position, zero-filled."""
    ref = materialize(ref)
    per = diff_events(df, ref, keep=[group]).groupBy(group, "position").agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    spine = ref.join(rows, group).where(F.col("ref_length") > 0).select(
        group, "n_rows",
        F.explode(F.sequence(F.lit(0), F.col("ref_length") - 1)).alias("position"),
    )
    n = F.coalesce("n", F.lit(0))
    return spine.join(per, [group, "position"], "left").select(
        group, "position", n.cast("long").alias("n"), (n / F.col("n_rows")).alias("rate")
    )


def position_entropy(
    df: DataFrame,
    group: Sequence[str] = ("grp",),
    alphabet: str | None = None,
    base: float = 2.0,
    normalize_k: int | None = None,
) -> DataFrame:
    """Shannon entropy of the symbols at each position.

    H = ln T - sum(c ln c) / T, one aggregate over the counts. ``normalize_k`` divides by
    ln k and clips to 1.
    """
    c = F.col("n").cast("double")
    out = symbol_counts(df, group, alphabet=alphabet).groupBy(*group, "position").agg(
        F.sum("n").alias("n_symbols"),
        F.sum(c * F.log(c)).alias("__s"),
        F.count(F.lit(1)).alias("n_distinct"),
    )
    nats = F.log("n_symbols") - F.col("__s") / F.col("n_symbols")
    if normalize_k:
        h = F.least(F.lit(1.0), nats / math.log(normalize_k))
    else:
        h = nats / math.log(base)
    return out.withColumn("entropy", F.greatest(F.lit(0.0), h)).drop("__s")


def _kmer_counts(texts: list[str], k: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Row, k-mer and count of every k-mer of every text; texts have at least ``k`` symbols."""
    joined = "".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    first, n = np.cumsum(size) - size, size - k + 1
    row = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    present = np.zeros(int(raw.max(initial=0)) + 1, bool)
    present[raw] = True
    code, most = (np.cumsum(present) - 1)[raw], int(present.sum())
    gram = code[at]
    if len(texts) * most**k < 1 << 62:
        for j in range(1, k):
            gram = gram * most + code[at + j]
        # Only the distinct k-mers of each text are numbered.
        pair, where, count = np.unique(row * most**k + gram, return_index=True, return_counts=True)
        _, sample, gram = np.unique(pair % most**k, return_index=True, return_inverse=True)
        names = [joined[i:i + k] for i in at[where[sample]].tolist()]
        return pair // most**k, [names[g] for g in gram.tolist()], count
    for j in range(1, k):  # numbered anew at every step, so numbers stay small
        gram = np.unique(gram * most + code[at + j], return_inverse=True)[1]
    _, sample = np.unique(gram, return_index=True)
    names = [joined[i:i + k] for i in at[sample].tolist()]
    pair, count = np.unique(row * len(names) + gram, return_counts=True)
    return pair // len(names), [names[g] for g in (pair % len(names)).tolist()], count


def kmer_profile(df: DataFrame, k: int = 2, key: str = "id", seq: str = "sequence") -> DataFrame:
    """Long sparse k-mer frequencies of each row: ``key, kmer, n, freq``. A row's counts are its own,
    so they are taken inside the batch and nothing is shuffled."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = pdf[seq].str.len().cumsum() // KMER_SYMBOLS
            for _, part in pdf.groupby(ends.to_numpy()):
                row, kmers, n = _kmer_counts(part[seq].tolist(), k)
                total = part[seq].str.len().to_numpy() - k + 1
                yield pd.DataFrame({key: part[key].take(row).to_numpy(), "kmer": kmers, "n": n, "freq": n / total[row]})

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.length(seq) >= k).select(key, seq).mapInPandas(
        count, f"`{key}` {kind}, kmer string, n long, freq double")


def composition(df: DataFrame, symbols: str, alphabet: str, seq: str = "sequence") -> DataFrame:
    """Share of chosen symbols and share of the alphabet present."""
    return df.withColumn("fraction", symbol_fraction(F.col(seq), symbols)).withColumn(
        "coverage", alphabet_coverage(F.col(seq), alphabet)
    )


def trim_gap_columns(
    df: DataFrame, group: str = "grp", gap: str = "-", seq: str = "sequence"
) -> DataFrame:
    """Remove alignment columns that hold only gaps in the whole group."""
    used = symbol_counts(df, (group,), seq).groupBy(group, "position").agg(
        F.max((F.col("symbol") != gap).cast("int")).alias("keep")
    )
    # One entry per alignment column: bounded by the row length.
    mask = used.groupBy(group).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "keep"))), lambda x: x["keep"] == 1
        ).alias("__mask")
    )
    kept = F.filter(
        F.arrays_zip(chars(F.col(seq)).alias("s"), F.col("__mask").alias("k")),
        lambda x: x["k"] & x["s"].isNotNull(),
    )
    trimmed = F.array_join(F.transform(kept, lambda x: x["s"]), "")
    return dim_join(df, mask, [group], "left").withColumn(
        seq, F.when(F.length(seq) > 0, trimmed).otherwise(F.col(seq))
    ).drop("__mask")


def variant_summary(events: DataFrame) -> DataFrame:
    """Per variant: frequency, first and last period, number of periods, first id.

    Counting per period first replaces the distinct count and shrinks the shuffle.
    """
    per = events.groupBy(*VARIANT, "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("__id")
    )
    return per.groupBy(*VARIANT).agg(
        F.sum("n").alias("frequency"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count(F.lit(1)).alias("n_periods"),
        F.min_by("__id", "period").alias("first_id"),
    )


def variant_frequency(events: DataFrame, records: DataFrame) -> DataFrame:
    """Variant counts divided by the rows of the group."""
    counts = events.groupBy(*VARIANT).agg(F.count(F.lit(1)).alias("count"))
    rows = records.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    return dim_join(counts, rows, ["grp"]).withColumn("frequency", F.col("count") / F.col("n_rows"))


def top_variants(
    df: DataFrame, n: int, per: Sequence[str] = (), by: str = "count", keys: Sequence[str] = VARIANT
) -> DataFrame:
    """Top ``n`` rows by a column, globally or per group; ties by key.

    Spark turns both forms into a map-side top-n before anything moves.
    """
    order = [F.col(by).desc(), *[F.col(k) for k in keys]]
    if not per:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def variant_trend(events: DataFrame, records: DataFrame, keys: DataFrame) -> DataFrame:
    """Frequency per period of the chosen variants, zero-filled over the periods of the group."""
    rows = records.groupBy("grp", "period").agg(F.count(F.lit(1)).alias("n_rows"))
    chosen = dim_join(events, keys.select(*VARIANT), VARIANT)
    n = chosen.groupBy(*VARIANT, "period").agg(F.count(F.lit(1)).alias("n"))
    spine = keys.select(*VARIANT).join(rows, "grp")
    filled = F.coalesce("n", F.lit(0)).cast("long")
    return spine.join(n, [*VARIANT, "period"], "left").select(
        *VARIANT, "period", "n_rows", filled.alias("n"), (filled / F.col("n_rows")).alias("frequency")
    )


def merged_regions(regions: DataFrame) -> DataFrame:
    """Half-open regions of each group as disjoint intervals: ``grp, start, end``."""
    r = regions.where(F.col("end") > F.col("start")).select("grp", "start", "end")
    before = Window.partitionBy("grp").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start") > F.coalesce(F.max("end").over(before), F.col("start") - 1)
    upto = Window.partitionBy("grp").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("__new", gap.cast("long"))
    return r.withColumn("__island", F.sum("__new").over(upto)).groupBy("grp", "__island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def flag_region(events: DataFrame, regions: DataFrame, out: str = "in_region") -> DataFrame:
    """Whether a position lies in any region of its group. Regions are the caller's data; they are
    merged and searched, never listed by position."""
    r = merged_regions(regions).select("grp", F.col("start").alias("__rs"), F.col("end").alias("__re"))
    return range_join(events, "position", r, "__rs", "__re", on=["grp"]).withColumn(
        out, F.col("__rs").isNotNull()).drop("__rs", "__re")


def region_enrichment(
    events: DataFrame, records: DataFrame, ref: DataFrame, regions: DataFrame, with_p: bool = True
) -> DataFrame:
    """Event density inside and outside the regions, their ratio and a goodness-of-fit chi2.

    The expected counts are proportional to the number of positions. Regions must be fixed
    independently of the data tested, otherwise the test is circular.
    """
    flagged = flag_region(events, regions).groupBy("grp").agg(
        F.sum(F.col("in_region").cast("long")).alias("in_events"),
        F.sum((~F.col("in_region")).cast("long")).alias("out_events"),
    )
    rows = records.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    lengths = ref.select("grp", "ref_length")
    inside = F.least("end", "ref_length") - F.greatest(F.col("start"), F.lit(0))
    width = merged_regions(regions).join(lengths, "grp").groupBy("grp").agg(
        F.sum(F.greatest(inside, F.lit(0)).cast("long")).alias("n_in"))
    t = lengths.join(rows, "grp").join(width, "grp", "left").join(flagged, "grp", "left")
    t = t.na.fill(0, ["n_in", "in_events", "out_events"])
    n_out = F.col("ref_length") - F.col("n_in")
    total = F.col("in_events") + F.col("out_events")
    density = lambda a, b: F.coalesce(ratio(F.col(a), F.col("n_rows").cast("double") * b), F.lit(0.0))
    t = t.withColumn("density_in", density("in_events", F.col("n_in")))
    t = t.withColumn("density_out", density("out_events", n_out))
    t = t.withColumn(
        "enrichment",
        F.when(F.col("density_out") > 0, F.col("density_in") / F.col("density_out")).otherwise(1.0),
    )
    e_in = ratio(total.cast("double") * F.col("n_in"), F.col("ref_length"))
    e_out = ratio(total.cast("double") * n_out, F.col("ref_length"))
    chi2 = F.when(
        (e_in > 0) & (e_out > 0),
        (F.col("in_events") - e_in) ** 2 / e_in + (F.col("out_events") - e_out) ** 2 / e_out,
    ).otherwise(0.0)
    t = t.withColumn("chi2", chi2)
    return t.withColumn("p", chi2_sf("chi2", F.lit(1.0))) if with_p else t


def flag_share(df: DataFrame, key: Sequence[str], flag: str, min_n: int, threshold: float) -> DataFrame:
    """Share of flagged rows per key with minimum support, and whether it reaches a threshold."""
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("n_flagged")
    ).where(F.col("n") >= min_n)
    out = out.withColumn("share", F.col("n_flagged") / F.col("n"))
    return out.withColumn("above", F.col("share") >= threshold)


def to_sequence(
    df: DataFrame, key: Sequence[str], order: Sequence[str], symbol: str, out: str = "sequence"
) -> DataFrame:
    """One string of symbols per record from an event log, in ``order``.

    The result is one value per record and so has to fit a row; for records without such a
    bound use ``to_positions``.
    """
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(symbol).alias("__s"))))
    return df.groupBy(*key).agg(
        F.array_join(F.transform(parts, lambda x: x["__s"]), "").alias(out)
    )


def to_positions(
    df: DataFrame, key: Sequence[str], order: str, symbol: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Long form of ``to_sequence``: ``key, position, symbol`` with 0-based positions.

    No record is collected: positions come from value buckets of the numeric ``order``, so one
    entity may hold any share of the events.
    """
    d = df.select(*key, F.col(order).alias("__o"), *ties, F.col(symbol).alias("symbol"))
    ranked = order_rank(d, key, "__o", ties)
    return ranked.select(*key, (F.col("rank") - 1).alias("position"), "symbol")


def median_length_reference(df: DataFrame, group: str = "grp", seq: str = "sequence") -> DataFrame:
    """Per group the row whose length is nearest the median length, smallest id on ties."""
    lengths = df.where(F.col(seq).isNotNull()).select(group, "id", F.length(seq).alias("length"))
    med = exact_quantiles(lengths, "length", {"median_length": 0.5}, [group])
    joined = dim_join(lengths, med, [group])
    pick = F.min(F.struct(
        F.abs(F.col("length") - F.col("median_length")).alias("d"), "id", "length"))
    return joined.groupBy(group, "median_length").agg(pick.alias("p")).select(
        group, "median_length", F.col("p.id").alias("id"), F.col("p.length").alias("length")
    )
