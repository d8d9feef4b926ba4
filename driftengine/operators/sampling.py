"""Reproducible sampling and splitting. Order is the md5 of ``key:seed``, never the layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftengine.scale import hash_rank, is_small, materialize


def _strata(df: DataFrame, stratum: str) -> DataFrame:
    return materialize(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("c")))


def _draw(
    df: DataFrame, stratum: str, strata: DataFrame, n: int | None, key: str, seed: int
) -> DataFrame:
    """Rows within each stratum's ``quota``; with ``n`` trimmed or topped up to n in hash order.

    How many rows the quotas give is known from the counts, so nothing is drawn twice.
    """
    picked = hash_rank(df, [stratum], key, seed, strata.select(stratum, "quota"))
    picked = picked.drop("rank", "total")
    if n is None:
        return picked
    got = strata.agg(F.coalesce(F.sum(F.least("quota", "c")), F.lit(0))).first()[0]
    if got > n:
        return hash_rank(picked, [], key, seed, n).drop("rank", "total")
    if got < n:
        rest = df.join(picked.select(key), key, "left_anti")
        more = hash_rank(rest, [], key, seed, int(n - got)).drop("rank", "total")
        return picked.unionByName(more)
    return picked


def sample_even(df: DataFrame, stratum: str, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """The same number of rows from each stratum, at most ``n`` in all."""
    strata = _strata(df, stratum)
    count = strata.count()
    strata = strata.withColumn("quota", F.lit(max(1, n // max(1, count))).cast("long"))
    got = strata.agg(F.coalesce(F.sum(F.least("quota", "c")), F.lit(0))).first()[0]
    return _draw(df, stratum, strata, n if got > n else None, key, seed)


def sample_proportional(
    df: DataFrame, stratum: str, n: int, key: str = "id", seed: int = 42
) -> DataFrame:
    """Proportional allocation with at least one row per stratum, adjusted to exactly ``n``.

    Missing rows go to the largest strata, surplus comes from the smallest with more than one;
    what strata cannot give is topped up from all other rows.
    """
    strata = _strata(df, stratum)
    total = strata.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    alloc = F.greatest(F.lit(1), F.floor(F.col("c") / F.lit(total) * F.lit(n)))
    strata = materialize(strata.withColumn("a", alloc.cast("long")))
    diff = n - (strata.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0])
    # One row per stratum: a small table, ordered once.
    if diff >= 0:
        w = Window.orderBy(F.col("c").desc(), F.col(stratum))
        bonus = (F.row_number().over(w) <= diff).cast("long")
    else:
        w = Window.orderBy((F.col("a") <= 1).cast("int"), F.col("c"), F.col(stratum))
        bonus = -((F.row_number().over(w) <= -diff) & (F.col("a") > 1)).cast("long")
    strata = materialize(strata.withColumn("quota", F.col("a") + bonus))
    return _draw(df, stratum, strata, n, key, seed)


def sample_boosted(
    df: DataFrame, stratum: str, value, frac: float, n: int, key: str = "id", seed: int = 42
) -> DataFrame:
    """One stratum gets a share of the slots, the others split the rest evenly; topped up to n."""
    strata = _strata(df, stratum)
    others = strata.where(~F.col(stratum).eqNullSafe(F.lit(value))).count()
    boost = int(n * frac)
    each = (n - boost) // max(1, others)
    quota = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(boost)).otherwise(F.lit(each))
    return _draw(df, stratum, strata.withColumn("quota", quota.cast("long")), n, key, seed)


def balance(df: DataFrame, label: str, cap: int, key: str = "id", seed: int = 42) -> DataFrame:
    """The same number of rows per class: the smallest class, at most ``cap``."""
    strata = _strata(df.where(F.col(label).isNotNull()), label)
    k = min(cap, strata.agg(F.coalesce(F.min("c"), F.lit(0))).first()[0])
    strata = strata.withColumn("quota", F.lit(k).cast("long"))
    return _draw(df, label, strata, None, key, seed)


def split(
    df: DataFrame, label: str, fractions: Sequence[float] = (0.6, 0.2, 0.2), key: str = "id",
    seed: int = 42, names: Sequence[str] = ("train", "validation", "test"),
) -> DataFrame:
    """Stratified split into named parts; column ``part``."""
    ranked = hash_rank(df, [label], key, seed)
    expr = F.lit(names[-1])
    edge = sum(fractions[:-1])
    for f, name in reversed(list(zip(fractions[:-1], names[:-1]))):
        expr = F.when(F.col("rank") <= F.floor(F.lit(round(edge, 12)) * F.col("total")), name).otherwise(expr)
        edge -= f
    return ranked.withColumn("part", expr).drop("rank", "total")


def temporal_folds(
    df: DataFrame, folds: DataFrame, min_train: int = 50, min_test: int = 20, col: str = "period"
) -> DataFrame:
    """Rows tagged ``(fold, role)``: train before ``train_max``, test in [test_min, test_max).

    ``folds(fold, train_max, test_min, test_max)``. A role depends on the period alone: folds meet
    the periods and their counts, and rows only join the resulting (period, fold, role) table by
    equality. Folds below the minimum sizes never touch the rows.
    """
    f = folds.select("fold", "train_max", "test_min", "test_max")
    per = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    role = F.when(F.col(col) < F.col("train_max"), "train").when(
        (F.col(col) >= F.col("test_min")) & (F.col(col) < F.col("test_max")), "test")
    # The folds' (period, role) pairs are the result of this step, not rows of the data.
    roles = materialize(per.join(f, F.col(col) < F.greatest("train_max", "test_max")).withColumn(
        "role", role).where("role is not null").select(col, "fold", "role", "n"))
    sizes = roles.groupBy("fold").agg(
        F.sum(F.when(F.col("role") == "train", F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("role") == "test", F.col("n")).otherwise(0)).alias("n_test"),
    )
    usable = sizes.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    keep = materialize(roles.join(usable.select("fold"), "fold").select(col, "fold", "role"))
    return df.join(F.broadcast(keep) if is_small(keep) else keep, col)


def expanding_folds(
    df: DataFrame, label: str = "label", min_test: int = 30, col: str = "period"
) -> DataFrame:
    """One row per period t: train = all earlier rows, test = the period; a note where the
    test is too small or has one class."""
    per = df.groupBy(col).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sum((F.col(label) == 1).cast("long")).alias("pos_test"),
    )
    before = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, -1)  # one row per period
    n_train = F.coalesce(F.sum("n_test").over(before), F.lit(0))
    out = per.withColumn("n_train", n_train)
    single = (F.col("pos_test") == 0) | (F.col("pos_test") == F.col("n_test"))
    return out.withColumn(
        "note",
        F.when((F.col("n_test") < min_test) | (F.col("n_train") == 0), "insufficient_data")
        .when(single, "single_class").otherwise(""),
    )


def group_holdout(events: DataFrame, col: str, values: Sequence, keys: Sequence[str]) -> DataFrame:
    """Per key whether it occurs in rows with one of the values (``held_out``), in one pass."""
    seen = F.max(F.coalesce(F.col(col).isin(list(values)), F.lit(False)).cast("int"))
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (seen == 1).alias("held_out"))


def kfold(df: DataFrame, k: int, label: str, key: str = "id", seed: int = 42) -> DataFrame:
    """Stratified fold number 0..k-1."""
    ranked = hash_rank(df, [label], key, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "total")


def leakage_audit(df: DataFrame, cutoff: int, col: str = "period", limit: float = 0.0) -> DataFrame:
    """Rows and share at or before a cutoff, and whether the share exceeds a limit."""
    early = F.col(col) <= cutoff
    t = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(early, 1)).alias("n_before"))
    t = t.withColumn("share", F.when(F.col("n") > 0, F.col("n_before") / F.col("n")).otherwise(0.0))
    return t.withColumn("verdict", F.when(F.col("share") > limit, "LEAKAGE").otherwise("OK"))
