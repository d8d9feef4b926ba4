"""Joins beyond the plain ones: unique right sides, shared keys, ordinal pairs, event windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftengine.functions.columns import ratio
from driftengine.scale import range_join


def inner_on(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "inner")


def left_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fill: dict) -> DataFrame:
    """Left join with defaults where the right side has no row."""
    return left.join(right, list(on), "left").na.fill(fill)


def join_unique(
    left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Left join that never multiplies rows: the right side keeps its first row per key."""
    rest = [c for c in right.columns if c not in on]
    lead = list(dict.fromkeys([*order, *rest]))
    one = right.groupBy(*on).agg(F.min(F.struct(*lead)).alias("__r"))
    one = one.select(*on, *[F.col("__r")[c].alias(c) for c in rest])
    return left.join(one, list(on), "left")


def keys_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def keys_not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def shared_keys(
    df: DataFrame, g1, g2, keys: Sequence[str], value: str = "frequency", group: str = "grp"
) -> DataFrame:
    """Keys present in two groups with both values and their sum.

    One conditional aggregate instead of a self-join: a single shuffle on the keys.
    """
    a = F.sum(F.when(F.col(group) == g1, F.col(value)))
    b = F.sum(F.when(F.col(group) == g2, F.col(value)))
    both = df.where(F.col(group).isin(g1, g2)).groupBy(*keys).agg(
        a.alias(f"{value}_a"), b.alias(f"{value}_b")
    )
    both = both.where(F.col(f"{value}_a").isNotNull() & F.col(f"{value}_b").isNotNull())
    return both.withColumn(f"combined_{value}", F.col(f"{value}_a") + F.col(f"{value}_b"))


def ordinal_pairs(dim: DataFrame, ext: DataFrame, max_steps: int) -> DataFrame:
    """Pairs a < b of an ordered list that are at most ``max_steps`` apart, joined with an external
    distance on the unordered pair. ``dim(name, ordinal)``, ``ext(a, b, distance)``.

    A name is listed at the ordinals it can reach, so pairs meet by equality and there are at most
    ``max_steps`` per name.
    """
    a = dim.select(F.col("name").alias("a"), F.col("ordinal").alias("ordinal_a"),
                   F.explode(F.sequence(F.col("ordinal") + 1, F.col("ordinal") + max_steps)).alias("ordinal_b"))
    b = dim.select(F.col("name").alias("b"), F.col("ordinal").alias("ordinal_b"))
    pairs = a.join(b, "ordinal_b").select("a", "b", "ordinal_a", "ordinal_b")
    pairs = pairs.withColumn("__lo", F.least("a", "b")).withColumn("__hi", F.greatest("a", "b"))
    e = ext.groupBy(F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi")).agg(
        F.avg("distance").alias("distance"))
    return pairs.join(e, ["__lo", "__hi"], "left").drop("__lo", "__hi").withColumn(
        "steps", F.col("ordinal_b") - F.col("ordinal_a"))


def pre_post(
    df: DataFrame, events: DataFrame, w: int, value: str, period: str = "period"
) -> DataFrame:
    """Mean and count of ``value`` in [t - w, t) and [t, t + w) for each event time t.

    Rows are summed per period first, so the range join sees one row per period.
    """
    per = df.groupBy(period).agg(
        F.sum(value).alias("__s"), F.count(value).alias("__n")
    )
    windows = events.select("event", "t", (F.col("t") - w).alias("__lo"), (F.col("t") + w).alias("__hi"))
    j = range_join(per, period, windows, "__lo", "__hi", how="inner")
    before = F.col(period) < F.col("t")

    def part(cond: Column, name: str):
        n = F.coalesce(F.sum(F.when(cond, F.col("__n"))), F.lit(0))
        return [ratio(F.sum(F.when(cond, F.col("__s"))), n).alias(f"{name}_mean"), n.alias(f"n_{name}")]

    found = j.groupBy("event", "t").agg(*part(before, "pre"), *part(~before, "post"))
    return events.select("event", "t").join(found, ["event", "t"], "left").na.fill(
        0, ["n_pre", "n_post"])


def union_like(parts: Sequence[DataFrame], renames: Sequence[dict[str, str]]) -> DataFrame:
    """UNION ALL of like tables after renaming their columns."""
    out = None
    for df, names in zip(parts, renames):
        df = df.withColumnsRenamed(names)
        out = df if out is None else out.unionByName(df)
    return out
