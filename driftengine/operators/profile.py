"""Profiling, quality checks, grouped summaries and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.functions.columns import ratio
from driftengine.operators.clean import bin_edges
from driftengine.scale import dim_join, exact_quantiles, materialize, most_frequent


def completeness(df: DataFrame) -> DataFrame:
    """Per column: filled, missing, pct filled. One pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    long = counts.unpivot(["__n"], list(df.columns), "column", "filled")
    return long.select(
        "column", "filled", (F.col("__n") - F.col("filled")).alias("missing"),
        F.when(F.col("__n") > 0, F.col("filled") * 100.0 / F.col("__n")).alias("pct_filled"),
    )


def duplicate_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n_repeats``: rows beyond the first of a key; ``n_in_groups``: all rows of repeated keys.

    Keys are counted by digest, so long texts are not shuffled.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    counts = df.groupBy(digest.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    total = F.sum("n")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.agg(
        zero(total).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        zero(F.sum(F.col("n") - 1)).alias("n_repeats"),
        zero(F.sum(repeated)).alias("n_in_groups"),
        zero(ratio(F.sum(repeated) * 100.0, total)).alias("pct_in_groups"),
    )


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``, equal ones by all other columns in theirs.

    One aggregate, combined map-side: a heavily repeated key costs one row per task, and the row
    does not depend on the layout. Maps, which have no order, compare as JSON.
    """
    rest = [F.to_json(f"`{f.name}`") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`")
            for f in df.schema.fields if f.name not in order and f.name not in key]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[F.col(f"`{c}`") for c in order], *[c.alias(f"r{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*key).agg(F.min_by(whole, rank).alias("__row"))
    return best.select("__row.*")


def summary(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, min, max, mean, exact median and sample sd."""
    by = list(by)
    stats = df.groupBy(*by).agg(
        F.count(col).alias("n"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
        F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("std"),
    )
    med = exact_quantiles(df, col, {"median": 0.5}, by)
    return stats.join(med, by, "left") if by else stats.join(F.broadcast(med))  # one row


def value_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """Top ``n`` values with their share of all rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.col("n").desc(), F.col(col)).limit(n).join(F.broadcast(total)).select(
        col, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct")
    )


def coverage_gaps(df: DataFrame, lo: int, hi: int, by: Sequence[str] = (), col: str = "period"):
    """Periods of an expected range without rows, per group."""
    spine = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(col)
    seen = df.select(*by, col).distinct()
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return groups.select(*by, spine).join(seen, [*by, col], "left_anti")


def profile_by(
    df: DataFrame, groups: Sequence[str], key: str, place: str, valid: Column, period: str = "period"
) -> DataFrame:
    """Rows, period range, distinct places and keys, share of valid keys per group."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(period).alias("min_period"),
        F.max(period).alias("max_period"),
        F.countDistinct(place).alias("n_places"),
        F.countDistinct(key).alias("n_keys"),
        (F.avg(valid.cast("double")) * 100).alias("valid_pct"),
    )


def count_matrix(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts with fixed columns, zero-filled, and a row total over those columns."""
    m = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    total = F.lit(0).cast("long")
    for v in values:
        total = total + F.col(f"`{v}`")
    return m.withColumn("Total", total)


def grouped_summary(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Count, min, max, mean, sd and mode (smallest on ties), from counts per value."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.count(col).alias("count"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
    )
    mode = most_frequent(df.where(F.col(col).isNotNull()), keys, col).select(*keys, "mode")
    return stats.join(mode, keys, "left")


def iqr_bounds(df: DataFrame, col: str, k: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, col, {"q1": 0.25, "q3": 0.75}, by)
    spread = F.lit(k) * (F.col("q3") - F.col("q1"))
    return q.select(*by, (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def iqr_outliers(
    df: DataFrame, col: str, k: float = 3.0, side: str = "both", by: Sequence[str] = ()
) -> DataFrame:
    """Rows flagged ``is_outlier`` outside the quartiles -+ k IQR."""
    bounds = iqr_bounds(df, col, k, by)
    j = dim_join(df, bounds, by) if by else df.join(F.broadcast(bounds))  # one row
    flag = F.col(col) > F.col("upper")
    if side == "both":
        flag = flag | (F.col(col) < F.col("lower"))
    return j.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("lower", "upper")


def head_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per group; cut to n per task before the shuffle for n up to 1000."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def rate_by(df: DataFrame, key: Sequence[str], predicate: Column, out: str = "rate") -> DataFrame:
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(predicate, 1)).alias("n_true"),
        F.avg(F.coalesce(predicate.cast("double"), F.lit(0.0))).alias(out),
    )


def histogram(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Rows per labelled bin, every label present."""
    counts = bin_edges(df, col, edges, labels).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    spine = spark.createDataFrame([(x,) for x in labels], "bin string")
    return spine.join(counts, "bin", "left").na.fill(0, ["n"])


def quality_verdict(
    df: DataFrame, keys: Sequence[str], id_col: str, pattern: str, length: str,
    max_duplicate_pct: float = 1.0,
) -> DataFrame:
    """One row: duplicate, missing, validity and length-consistency rates, and the verdict.

    CLEAN below the duplicate limit, FLAG otherwise.
    """
    dup = duplicate_stats(df, keys).select(F.col("pct_in_groups").alias("duplicate_pct"))
    miss = completeness(df).agg(
        ratio(F.sum("missing") * 100.0, F.sum(F.col("missing") + F.col("filled"))).alias("missing_pct")
    )
    valid = df.agg(
        (F.avg(F.coalesce(F.col(id_col).cast("string").rlike(pattern), F.lit(False)).cast("double"))
         * 100).alias("valid_pct")
    )
    consistent = iqr_outliers(df.select(length), length).agg(
        (F.lit(100.0) - F.avg(F.col("is_outlier").cast("double")) * 100).alias("consistent_pct")
    )
    one = dup.join(F.broadcast(miss)).join(F.broadcast(valid)).join(F.broadcast(consistent))
    return one.withColumn(
        "verdict", F.when(F.col("duplicate_pct") < max_duplicate_pct, "CLEAN").otherwise("FLAG")
    )


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def profile_rollup(
    df: DataFrame, group: str, conditions: Mapping[str, Column], place: str, length: str,
    period: str = "period", total: str = "TOTAL",
) -> DataFrame:
    """Group profile with one grand-total row; medians are exact."""
    named = df.select(group, place, length, period, *[c.alias(n) for n, c in conditions.items()])
    counted = [F.count(F.when(F.col(n), 1)).alias(n) for n in conditions]
    stats = named.rollup(group).agg(
        F.grouping(group).alias("__total"),
        F.count(F.lit(1)).alias("N_total"),
        *counted,
        F.min(period).alias("min_period"),
        F.max(period).alias("max_period"),
        F.countDistinct(place).alias("N_places"),
        F.avg(length).alias("mean_length"),
        F.stddev_samp(length).alias("std_length"),
    )
    # Counted once: both medians come from the counts per group and length.
    lengths = materialize(df.groupBy(group, length).agg(F.count(F.lit(1)).alias("__w")))
    med = exact_quantiles(lengths, length, {"median_length": 0.5}, [group], "__w").withColumn(
        "__total", F.lit(0))
    overall = exact_quantiles(lengths, length, {"median_length": 0.5}, weight="__w").select(
        F.lit(None).cast("string").alias(group), "median_length", F.lit(1).alias("__total"))
    medians = med.unionByName(overall).withColumnRenamed(group, "__g")
    medians = medians.withColumnRenamed("__total", "__t2")
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__total") == F.col("__t2"))
    joined = stats.join(medians, same, "left")
    name = F.when(F.col("__total") == 1, F.lit(total)).otherwise(F.col(group))
    return joined.withColumn(group, name).drop("__total", "__t2", "__g")
