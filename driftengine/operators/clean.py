"""Cleaning, typing, binning, labelling and normalising columns of records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftengine.scale import (
    dim_join,
    exact_quantiles,
    most_frequent,
    range_join,
    rank_join,
    value_ranks,
)


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without nulls in ``cols``; ``dropped_count`` reports the loss."""
    return df.dropna(subset=list(cols))


def dropped_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows kept and dropped by ``drop_null``, in one pass."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(ok, 1)).alias("n_kept"),
        F.count(F.when(~ok, 1)).alias("n_dropped"),
    )


def coerce_int(df: DataFrame, col: str) -> DataFrame:
    """Number or bad text to integer; rows that are no number are dropped."""
    as_number = F.col(col).cast("string").try_cast("double")
    usable = as_number.isNotNull() & ~F.isnan(as_number)
    return df.where(usable).withColumn(col, as_number.try_cast("int")).where(F.col(col).isNotNull())


def with_length(df: DataFrame, seq: str = "sequence") -> DataFrame:
    return df.withColumn("length", F.length(seq))


def equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def one_of(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def contains_text(df: DataFrame, col: str, text: str) -> DataFrame:
    """Case-insensitive substring filter."""
    return df.where(F.contains(F.lower(col), F.lit(text.lower())))


def between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def canonical(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """Sequence as trimmed upper-case text."""
    return df.withColumn(seq, F.upper(F.btrim(F.col(seq).cast("string"), F.lit(" \t\n\r\f\v"))))


def min_length(df: DataFrame, n: int = 50, seq: str = "sequence") -> DataFrame:
    """Rows with more than ``n`` symbols."""
    return df.where(F.length(seq) > n)


def _with_modal(df: DataFrame, group: Sequence[str], seq: str) -> DataFrame:
    keyed = df.withColumn("length", F.length(seq))
    modal = most_frequent(
        keyed.where(F.col("length").isNotNull()), group, "length", "modal_length", "n_modal"
    ).drop("n_modal")
    if group:
        return dim_join(keyed, modal, group)
    return keyed.join(F.broadcast(modal))  # a global aggregate: one row


def modal_length(df: DataFrame, group: Sequence[str] = (), seq: str = "sequence") -> DataFrame:
    """Rows at the most frequent length of their group (shortest on ties)."""
    return _with_modal(df, list(group), seq).where(F.col("length") == F.col("modal_length"))


def length_band(
    df: DataFrame, p: float = 0.05, group: Sequence[str] = (), seq: str = "sequence"
) -> DataFrame:
    """Rows within +-p of the modal length."""
    m = F.col("modal_length")
    return _with_modal(df, list(group), seq).where(
        F.col("length").between(m * (1 - p), m * (1 + p))
    )


def format_valid(df: DataFrame, col: str, pattern: str, out: str = "valid") -> DataFrame:
    """Whether a key matches a pattern; null is invalid."""
    return df.withColumn(out, F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def format_rate(df: DataFrame, col: str, pattern: str) -> DataFrame:
    flagged = format_valid(df, col, pattern)
    return flagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("valid"), 1)).alias("n_valid"),
        (F.avg(F.col("valid").cast("double")) * 100).alias("valid_pct"),
    )


def in_alphabet(df: DataFrame, cols: Sequence[str], alphabet: str) -> DataFrame:
    """Rows whose symbols are all in the alphabet."""
    for c in cols:
        df = df.where(F.col(c).isin(list(alphabet)))
    return df


def classify_length(df: DataFrame, n: int, seq: str = "sequence") -> DataFrame:
    return df.withColumn(
        "completeness", F.when(F.length(seq) >= n, F.lit("complete")).otherwise(F.lit("partial"))
    )


def bin_edges(
    df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str = "bin"
) -> DataFrame:
    """Left-closed bins ``[edge, next edge)`` with labels; outside is null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval")
    expr = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = F.col(col) >= F.lit(lo)
        if hi != float("inf"):
            inside = inside & (F.col(col) < F.lit(hi))
        expr = F.when(inside, F.lit(label)).otherwise(expr)
    return df.withColumn(out, expr)


def bin_width(df: DataFrame, col: str, n: int, out: str = "bin") -> DataFrame:
    """``n`` equal-width bins 0..n-1 over the global range, left-closed, last one closed."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    pos = F.floor((F.col(col) - lo) * n / (hi - lo))
    binned = df.join(F.broadcast(ends))  # a global aggregate: one row
    value = F.when(hi > lo, F.least(pos, F.lit(n - 1))).when(F.col(col).isNotNull(), F.lit(0))
    return binned.withColumn(out, value.cast("int")).drop("__lo", "__hi")


def bin_quantile(df: DataFrame, col: str, q: int, out: str = "bin") -> DataFrame:
    """Quantile bins 0..q-1, right-closed like the usual q-cut; equal edges merge."""
    names = {f"__e{i}": i / q for i in range(1, q)}
    edges = exact_quantiles(df, col, names)
    joined = df.join(F.broadcast(edges))  # a global aggregate: one row
    distinct = F.array_distinct(F.array(*names))
    above = F.size(F.filter(distinct, lambda e: F.col(col) > e))
    value = F.when(F.col(col).isNotNull(), above)
    return joined.withColumn(out, value.cast("int")).drop(*names)


def bin_step(
    df: DataFrame, col: str, step: float, lo: int | None = None, hi: int | None = None,
    out: str = "bin",
) -> DataFrame:
    """Integer-division bin, clipped to ``[lo, hi]``."""
    b = F.floor(F.col(col) / F.lit(step))
    if lo is not None:
        b = F.greatest(b, F.lit(lo))
    if hi is not None:
        b = F.least(b, F.lit(hi))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), b).cast("int"))


def label_interval(
    df: DataFrame, dim: DataFrame, col: str = "period", default: str = "Other",
    missing: str = "Unknown", out: str = "label",
) -> DataFrame:
    """Name of the half-open interval ``(name, start, end)`` that holds a value."""
    d = dim.select(F.col("name").alias(out), F.col("start").alias("__s"), F.col("end").alias("__e"))
    joined = range_join(df, col, d, "__s", "__e").drop("__s", "__e")
    return joined.withColumn(
        out, F.when(F.col(col).isNull(), F.lit(missing)).otherwise(F.coalesce(out, F.lit(default)))
    )


def label_ordinal(
    df: DataFrame, dim: DataFrame, k: int, col: str = "period"
) -> DataFrame:
    """Interval name and ordinal; values before (after) all intervals, or in a gap, take the
    first (last) interval. ``label`` = ordinal >= k."""
    ends = dim.agg(
        F.min(F.struct("start", "name", "ordinal")).alias("__first"),
        F.max(F.struct("end", "name", "ordinal")).alias("__last"),
    )
    d = dim.select("name", "ordinal", F.col("start").alias("__s"), F.col("end").alias("__e"))
    j = range_join(df, col, d, "__s", "__e").join(F.broadcast(ends))  # one row
    early = F.col(col) < F.col("__first.start")
    outside = lambda f: F.when(early, F.col(f"__first.{f}")).when(
        F.col(col).isNotNull(), F.col(f"__last.{f}"))
    j = j.withColumn("cluster_name", F.coalesce("name", outside("name")))
    j = j.withColumn("ordinal", F.coalesce("ordinal", outside("ordinal")))
    return j.withColumn("label", (F.col("ordinal") >= k).cast("int")).drop(
        "name", "__s", "__e", "__first", "__last"
    )


def label_contains(
    df: DataFrame, col: str, rules: Sequence[tuple[str, str]], default: str = "Other",
    out: str = "label",
) -> DataFrame:
    """First label whose text occurs in the upper-cased column."""
    expr = F.lit(default)
    for text, label in reversed(list(rules)):
        expr = F.when(F.contains(F.upper(col), F.lit(text.upper())), F.lit(label)).otherwise(expr)
    return df.withColumn(out, expr)


def symbol_attributes(
    df: DataFrame, a: str, b: str, dim: DataFrame, attr: str, default: float = 0.0
) -> DataFrame:
    """Attribute value of two symbols from a user table ``(symbol, value)``: both, the
    difference b - a and whether it changed."""
    for c, side in ((a, "ref"), (b, "var")):
        d = dim.select(F.col("symbol").alias(c), F.col("value").alias(f"{side}_{attr}"))
        df = dim_join(df, d, [c], "left").na.fill(default, [f"{side}_{attr}"])
    return df.withColumn(f"{attr}_delta", F.col(f"var_{attr}") - F.col(f"ref_{attr}")).withColumn(
        f"{attr}_changed", (F.col(f"var_{attr}") != F.col(f"ref_{attr}")).cast("int")
    )


def pair_score(
    df: DataFrame, a: str, b: str, matrix: DataFrame, missing: int = -4, conservative: int = 1
) -> DataFrame:
    """Score of an unordered symbol pair from a user table ``(a, b, score)``."""
    m = matrix.groupBy(
        F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi")
    ).agg(F.max("score").alias("score"))
    keyed = df.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
    out = dim_join(keyed, m, ["__lo", "__hi"], "left").drop("__lo", "__hi")
    out = out.withColumn("score", F.coalesce("score", F.lit(missing)))
    return out.withColumn("conservative", (F.col("score") >= conservative).cast("int"))


def normalize(
    df: DataFrame, col: str, how: str, out: str | None = None, scale: float = 1.0
) -> DataFrame:
    """``clip`` (to [0, scale] / scale), ``log1p_max``, ``min_max`` or ``percent_rank``
    (average rank / count)."""
    out = out or f"{col}_norm"
    c = F.col(col)
    if how == "clip":
        clipped = F.least(F.greatest(c, F.lit(0.0)), F.lit(float(scale)))
        return df.withColumn(out, clipped / F.lit(float(scale)))
    if how in ("log1p_max", "min_max"):
        ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
        j = df.join(F.broadcast(ends))  # a global aggregate: one row
        if how == "log1p_max":
            value = F.log1p(c) / (F.log1p("__hi") + F.lit(1e-9))
        else:
            span = F.col("__hi") - F.col("__lo")
            value = F.when(span > 0, (c - F.col("__lo")) / span).otherwise(F.lit(0.0))
        return j.withColumn(out, value).drop("__lo", "__hi")
    if how == "percent_rank":
        average = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
        r = value_ranks(df, col).withColumn(out, average / F.col("total"))
        return rank_join(df, col, r, [out])
    raise ValueError(f"unknown normaliser {how}")


def weighted_score(df: DataFrame, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(w)
    return df.withColumn(out, total)


def product_score(df: DataFrame, cols: Sequence[str], out: str = "score") -> DataFrame:
    total = F.lit(1.0)
    for c in cols:
        total = total * F.col(c)
    return df.withColumn(out, total)


def evidence_score(
    df: DataFrame, rules: Sequence[tuple[Column, int]], maximum: int, threshold: float = 0.5,
    out: str = "evidence",
) -> DataFrame:
    """Points of the rules that hold over the maximum, and whether it reaches a threshold."""
    points = F.lit(0)
    for cond, p in rules:
        points = points + F.when(cond, F.lit(p)).otherwise(F.lit(0))
    return df.withColumn("points", points).withColumn(out, points / F.lit(maximum)).withColumn(
        "supported", (F.col(out) >= threshold).cast("int")
    )


def label_with_fallback(
    df: DataFrame, labels: DataFrame, key: str, label: str, fallback: Column
) -> DataFrame:
    """Stored label, or the rule where none is stored. One label per key is used."""
    one = labels.groupBy(key).agg(F.min(label).alias("__label"))
    joined = df.join(one, key, "left")
    return joined.withColumn(label, F.coalesce("__label", fallback)).withColumn(
        "from_rule", F.col("__label").isNull()
    ).drop("__label")
