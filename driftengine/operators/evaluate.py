"""Evaluation of scores and clusters: metrics, curves, thresholds, comparisons, ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftengine.functions.columns import ratio
from driftengine.functions.tails import normal_two_sided
from driftengine.operators.stats import auc_by
from driftengine.scale import dim_join, materialize, rank_join, running_totals


def _score_counts(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Positives ``wp`` and negatives ``wn`` per score: the one pass over the rows."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return materialize(d.groupBy(*by, F.col(p).cast("double").alias("score")).agg(
        F.sum((F.col(y) == 1).cast("double")).alias("wp"),
        F.sum((F.col(y) != 1).cast("double")).alias("wn")))


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, MCC and AUC (average ranks on ties)."""
    by = list(by)
    cells = _score_counts(df, y, p, by)
    yes = F.col("score") >= threshold
    count = lambda c, cond, name: F.coalesce(
        F.sum(F.when(cond, F.col(c))), F.lit(0.0)).cast("long").alias(name)
    t = cells.groupBy(*by).agg(
        count("wp", yes, "tp"), count("wn", yes, "fp"), count("wp", ~yes, "fn"), count("wn", ~yes, "tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    t = t.select(
        *by, "tp", "fp", "fn", "tn",
        div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"),
        div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(tp * tn - fp * fn, spread).alias("mcc"))
    auc = auc_by(cells, by, ready=True).withColumnRenamed("value", "auc")
    out = t.join(auc, by, "left") if by else t.join(F.broadcast(auc))  # one row
    return out.withColumn("auc", F.coalesce("auc", F.lit(0.5)))


def _quantile(level: float) -> float:
    """Half width of a two-sided normal interval, in standard errors."""
    return NormalDist().inv_cdf((1 + level) / 2)


def _placements(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per counted score: P, N, ``v10`` (share of negatives that a positive there is above, ties half)
    and ``v01`` (share of positives that are above a negative there)."""
    cum = running_totals(cells, "score", {"wn": "__cn", "wp": "__cp"}, by, ready=True)
    totals = cells.groupBy(*by).agg(F.sum("wp").alias("P"), F.sum("wn").alias("N"))
    j = dim_join(cum, totals, by) if by else cum.join(F.broadcast(totals))  # one row
    return j.select(
        *by, "score", "wp", "wn", "P", "N", ratio(F.col("__cn") - F.col("wn") / 2, F.col("N")).alias("v10"),
        ratio(F.col("P") - F.col("__cp") + F.col("wp") / 2, F.col("P")).alias("v01"))


def _moment(weight: str, x: str, y: str, mean: Column, n: Column) -> Column:
    """Sample covariance of two placement values with means ``mean`` squared away."""
    return F.try_divide(F.sum(F.col(weight) * F.col(x) * F.col(y)) - n * mean, n - 1)


def auc_interval(df: DataFrame, y: str, p: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """AUC with its standard error and interval after DeLong, in closed form from counted scores:
    ``n_pos, n_neg, auc, auc_se, auc_lo, auc_hi`` per group, the interval within [0, 1].

    A group without one of the classes has null; with a single row of one it has no standard error.
    """
    by = list(by)
    v = _placements(_score_counts(df, y, p, by), by)
    big_p, big_n = F.first("P"), F.first("N")
    auc = F.sum(F.col("wp") * F.col("v10")) / F.nullif(big_p, F.lit(0.0))
    variance = (F.greatest(_moment("wp", "v10", "v10", auc * auc, big_p), F.lit(0.0)) / F.nullif(big_p, F.lit(0.0))
                + F.greatest(_moment("wn", "v01", "v01", auc * auc, big_n), F.lit(0.0)) / F.nullif(big_n, F.lit(0.0)))
    enough = (big_p > 1) & (big_n > 1)
    t = v.groupBy(*by).agg(
        big_p.cast("long").alias("n_pos"), big_n.cast("long").alias("n_neg"), auc.alias("auc"),
        F.when(enough, F.sqrt(variance)).alias("auc_se"))
    z = F.lit(_quantile(level))
    return t.withColumn("auc_lo", F.greatest(F.col("auc") - z * F.col("auc_se"), F.when(F.col("auc_se").isNotNull(), 0.0))) \
        .withColumn("auc_hi", F.least(F.col("auc") + z * F.col("auc_se"), F.when(F.col("auc_se").isNotNull(), 1.0)))


def auc_difference(df: DataFrame, y: str, first: str, second: str, level: float = 0.95) -> DataFrame:
    """Change of AUC from the score ``first`` to ``second`` of the same rows, after DeLong: one row
    ``auc_a, auc_b, delta, delta_se, delta_lo, delta_hi, p``.

    Both scores are counted and placed on their own; every row then meets its two placement values,
    and only sums of their products are needed. Rows with a null in either score take no part.
    """
    d = df.where(F.col(y).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        (F.col(y) == 1).cast("double").alias("wp"), (F.col(y) != 1).cast("double").alias("wn"),
        F.col(first).cast("double").alias("__a"), F.col(second).cast("double").alias("__b"))
    totals = d.agg(F.coalesce(F.sum("wp"), F.lit(0.0)).alias("P"), F.coalesce(F.sum("wn"), F.lit(0.0)).alias("N"))
    # Rows of equal scores are one from here on.
    d = materialize(d.groupBy("__a", "__b").agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn")))
    for col in ("__a", "__b"):
        cells = d.groupBy(F.col(col).alias("score")).agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))
        placed = _placements(materialize(cells), []).select(
            F.col("score").alias("value"), (F.col("wp") + F.col("wn")).alias("n"), (F.col("P") + F.col("N")).alias("total"),
            F.col("v10").alias(f"{col}10"), F.col("v01").alias(f"{col}01"))
        d = rank_join(d, col, placed, [f"{col}10", f"{col}01"])
    sums = [F.sum(F.col("wp") * F.col("__a10")).alias("a"), F.sum(F.col("wp") * F.col("__b10")).alias("b")]
    for w, k in (("wp", "10"), ("wn", "01")):
        for x, y_ in (("__a", "__a"), ("__b", "__b"), ("__a", "__b")):
            sums.append(F.sum(F.col(w) * F.col(x + k) * F.col(y_ + k)).alias(f"{x[2:]}{y_[2:]}{k}"))
    t = d.agg(*sums).join(F.broadcast(totals))  # one row each
    none = F.lit(0.0)
    t = t.withColumn("a", F.try_divide("a", "P")).withColumn("b", F.try_divide("b", "P"))
    total = none
    for w, k in (("P", "10"), ("N", "01")):
        n = F.col(w)
        cov = lambda xy: F.try_divide(F.col(xy + k) - n * F.col(xy[0]) * F.col(xy[1]), n - 1)  # noqa: B023,E731
        total = total + F.greatest(F.try_divide(cov("aa") + cov("bb") - 2 * cov("ab"), n), none)
    enough = (F.col("P") > 1) & (F.col("N") > 1)
    t = t.select(F.col("a").alias("auc_a"), F.col("b").alias("auc_b"), (F.col("b") - F.col("a")).alias("delta"),
                 F.when(enough, F.sqrt(total)).alias("delta_se"))
    z = _quantile(level)
    t = t.withColumn("delta_lo", F.col("delta") - z * F.col("delta_se")).withColumn(
        "delta_hi", F.col("delta") + z * F.col("delta_se"))
    # Without any spread a difference is either none or certain.
    z_value = F.when(F.col("delta_se") > 0, F.abs(F.col("delta")) / F.col("delta_se"))
    return t.withColumn("p", F.when(F.col("delta_se") > 0, normal_two_sided(z_value)).when(
        F.col("delta_se") == 0, (F.col("delta") == 0).cast("double")))


def roc_points(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, from the highest: threshold, tpr, fpr (ties together)."""
    by = list(by)
    cells = _score_counts(df, y, p, by)
    cum = running_totals(cells, "score", {"wp": "tp", "wn": "fp"}, by, descending=True, ready=True)
    totals = cells.groupBy(*by).agg(F.sum("wp").alias("P"), F.sum("wn").alias("N"))
    j = dim_join(cum, totals, by) if by else cum.join(F.broadcast(totals))  # one row
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return j.select(
        *by, F.col("score").alias("threshold"), F.col("tp").cast("long").alias("tp"),
        F.col("fp").cast("long").alias("fp"), rate("tp", "P").alias("tpr"), rate("fp", "N").alias("fpr"),
        (F.col("P") - F.col("tp")).cast("long").alias("fn"))


def best_threshold(df: DataFrame, y: str, p: str, lo: float = 0.35, hi: float = 0.65, by: Sequence[str] = ()) -> DataFrame:
    """Score with the best F1 (lowest on ties), clipped to [lo, hi]."""
    r = roc_points(df, y, p, by)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    r = r.withColumn("f1", F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))
    best = r.groupBy(*by).agg(F.min(F.struct((-F.col("f1")).alias("m"), "threshold")).alias("b"))
    raw = F.col("b.threshold")
    return best.select(
        *by, raw.alias("raw_threshold"), F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)).alias("threshold"),
        (-F.col("b.m")).alias("f1"))


def fold_summary(df: DataFrame, model: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample sd of metrics over folds, per model."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    return df.groupBy(model).agg(*aggs)


def compare_models(df: DataFrame, model: str, metric: str, subject: str) -> DataFrame:
    """Difference of each model to the best one other than ``subject``; one row per model."""
    best = df.where(F.col(model) != subject).agg(F.max(metric).alias("best_baseline"))
    j = df.join(F.broadcast(best))  # one row
    return j.withColumn("delta", F.col(metric) - F.col("best_baseline")).withColumn(
        "is_subject", F.col(model) == subject)


def degradation(metrics: DataFrame, cohort: str, reference, cols: Sequence[str]) -> DataFrame:
    """Change of metrics against a reference cohort; one row per cohort."""
    ref = metrics.where(F.col(cohort) == reference).agg(*[F.max(c).alias(f"__{c}") for c in cols])
    out = metrics.join(F.broadcast(ref))  # one row
    for c in cols:
        out = out.withColumn(f"delta_{c}", F.col(c) - F.col(f"__{c}"))
    return out.drop(*[f"__{c}" for c in cols])


def auc_degradation(df: DataFrame, y: str, p: str, cohort: str, reference, level: float = 0.95) -> DataFrame:
    """AUC of every cohort with its interval, and the change against a reference cohort of other rows:
    the columns of ``auc_interval`` and ``delta_auc, delta_lo, delta_hi``. Variances add up; the
    reference's own change is 0 without an interval."""
    t = materialize(auc_interval(df, y, p, level, [cohort]))
    ref = t.where(F.col(cohort) == reference).select(F.col("auc").alias("__auc"), F.col("auc_se").alias("__se"))
    z = _quantile(level)
    out = t.join(F.broadcast(ref), F.lit(True), "left")  # one row
    other = ~F.col(cohort).eqNullSafe(F.lit(reference))
    delta = F.col("auc") - F.col("__auc")
    se = F.when(other, F.sqrt(F.col("auc_se") * F.col("auc_se") + F.col("__se") * F.col("__se")))
    return out.withColumn("delta_auc", delta).withColumn("delta_lo", delta - z * se).withColumn(
        "delta_hi", delta + z * se).drop("__auc", "__se")


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: size, dominant label, purity."""
    counts = df.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))
    return counts.groupBy(cluster).agg(F.sum("n").alias("size"), best.alias("b")).select(
        cluster, "size", F.col("b.l").alias("dominant"), (-F.col("b.m")).alias("n_dominant"),
        (-F.col("b.m") / F.col("size")).alias("purity"))


def purity_overall(df: DataFrame, cluster: str, label: str, passing: float = 0.70, marginal: float = 0.60) -> DataFrame:
    """Overall purity and its verdict."""
    t = purity(df, cluster, label).agg(
        F.sum("size").alias("n"), (F.sum("n_dominant") / F.sum("size")).alias("purity"))
    return t.withColumn("verdict", F.when(F.col("purity") > passing, "PASS").when(
        F.col("purity") >= marginal, "MARGINAL").otherwise("FAIL"))


def ensemble(df: DataFrame, cols: Sequence[str], vote: float = 0.5) -> DataFrame:
    """Mean probability, votes above 0.5, confidence band and whether all models agree.

    A missing model counts as the mean of the others.
    """
    known = F.filter(F.array(*cols), lambda x: x.isNotNull())
    mean = ratio(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    df = df.withColumn("__m", mean)
    filled = F.array(*[F.coalesce(c, "__m") for c in cols])
    df = df.withColumn("ensemble_prob", F.aggregate(filled, F.lit(0.0), lambda a, x: a + x) / len(cols))
    votes = F.size(F.filter(filled, lambda x: x > vote))
    df = df.withColumn("models_predict_drift", votes).drop("__m")
    v = F.col("models_predict_drift")
    band = F.when(v == 0, "NORMAL").when(v == 1, "LOW").when(v == 2, "MEDIUM").otherwise("HIGH")
    return df.withColumn("confidence", band).withColumn("agree", (v == 0) | (v == len(cols)))


def ensemble_summary(df: DataFrame, passing: float = 70.0) -> DataFrame:
    t = df.agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("agree").cast("double")) * 100).alias("agreement_pct"),
        F.avg("ensemble_prob").alias("mean_prob"),
        *[F.count(F.when(F.col("confidence") == c, 1)).alias(f"n_{c.lower()}") for c in ("HIGH", "MEDIUM", "LOW", "NORMAL")])
    return t.withColumn("status", F.when(F.col("agreement_pct") > passing, "PASS").otherwise("FAIL"))
