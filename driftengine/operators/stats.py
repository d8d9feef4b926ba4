"""Rates, tests, effect sizes, bootstrap intervals and multiple-testing control.

Every statistic is built from sums and counts; tail probabilities are taken on the result row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.functions.columns import ratio
from driftengine.functions.tails import (
    chi2_sf,
    fisher_greater,
    normal_sf,
    normal_two_sided,
    t_two_sided,
)
from driftengine.scale import (
    dim_join,
    exact_quantiles,
    materialize,
    rank_join,
    running_totals,
    value_buckets,
    value_ranks,
)


def rate_through_origin(
    df: DataFrame, t: Column, d: Column, w: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Weighted slope of a line through the origin: sum(w t d) / sum(w t^2)."""
    w = F.lit(1.0) if w is None else w
    return df.groupBy(*by).agg(ratio(F.sum(w * t * d), F.sum(w * t * t)).alias("rate"))


def _t_of_r2(slope: Column, r2: Column, n: Column) -> Column:
    return F.signum(slope) * F.sqrt(r2 * (n - 2) / (F.lit(1.0) - r2))


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Least squares per group: slope, intercept, r2, n and the two-sided p of the slope."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.groupBy(*by).agg(
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
        F.regr_count(ys, xs).alias("n"),
    )
    if not with_p:
        return out
    t = F.when(
        (F.col("n") > 2) & (F.col("r2") < 1), _t_of_r2(F.col("slope"), F.col("r2"), F.col("n")))
    exact = (F.col("n") > 2) & (F.col("r2") >= 1)
    return out.withColumn(
        "p", F.when(exact, F.lit(0.0)).otherwise(t_two_sided(t, F.col("n").cast("double") - 2)))


def endpoint_rate(df: DataFrame, t: str, d: str, by: Sequence[str] = ()) -> DataFrame:
    """(last - first) / span."""
    out = df.groupBy(*by).agg(
        F.min_by(d, t).alias("first"), F.max_by(d, t).alias("last"),
        (F.max(t) - F.min(t)).alias("span"),
    )
    rate = F.when(F.col("span") > 0, (F.col("last") - F.col("first")) / F.col("span"))
    return out.withColumn("rate", rate)


def compare_to(df: DataFrame, value: str, benchmark: float, tol: float) -> DataFrame:
    """Percent difference from a benchmark and PASS or FAIL within a tolerance (percent)."""
    diff = (F.col(value) - F.lit(benchmark)) / F.lit(benchmark) * 100
    return df.withColumn("pct_diff", diff).withColumn(
        "status", F.when(F.abs("pct_diff") <= tol, "PASS").otherwise("FAIL"))


def trend_class(
    df: DataFrame, x: str, y: str, by: Sequence[str], flat: float = 0.3, rapid: float = 1.5
) -> DataFrame:
    """Plateau, or steady / rapid increase / decrease, from the slope per band."""
    t = linear_trend(df, x, y, by, with_p=False)
    s = F.col("slope")
    kind = F.concat(
        F.when(F.abs(s) > rapid, "rapid").otherwise("steady"), F.lit(" "),
        F.when(s > 0, "increase").otherwise("decrease"))
    return t.withColumn(
        "trend",
        F.when(F.col("n") < 2, "single data point").when(s.isNull(), "single data point")
        .when(F.abs(s) < flat, "plateau").otherwise(kind))


def chi2_gof(df: DataFrame, obs: str, exp: str, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Goodness of fit over the rows of a group."""
    d = F.col(obs) - F.col(exp)
    out = df.groupBy(*by).agg(
        F.sum(ratio(d * d, F.col(exp))).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    return out.withColumn("p", chi2_sf("chi2", F.col("dof").cast("double"))) if with_p else out


def chi2_contingency(df: DataFrame, a: str, b: str, with_p: bool = True) -> DataFrame:
    """Independence test of two categorical columns and Cramer's V, no continuity correction.

    Filled cells add (O - E)^2 / E; empty ones add their E, which is N less the E of the filled ones,
    so they need no grid and nothing cancels where the columns are nearly independent.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    cells = materialize(cells)
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").cast("double").alias("__n"))
    o, e = F.col("o").cast("double"), F.col("r").cast("double") * F.col("c") / F.col("__n")
    out = cells.join(rows, "a").join(cols, "b").join(F.broadcast(total)).agg(  # one row
        F.sum("o").alias("n"),
        F.sum((o - e) * (o - e) / e).alias("__filled"),
        (F.max("__n") - F.sum(e)).alias("__empty"),
        F.count(F.lit(1)).alias("__cells"),
        F.countDistinct("a").alias("__ra"),
        F.countDistinct("b").alias("__cb"),
    )
    k = F.least("__ra", "__cb") - 1
    grid = F.col("__cells") < F.col("__ra") * F.col("__cb")
    out = out.withColumn("chi2", F.col("__filled") + F.when(grid, F.greatest("__empty", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("dof", (F.col("__ra") - 1) * (F.col("__cb") - 1)).withColumn(
        "cramers_v", F.when(k > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("n") * k)))
        .otherwise(0.0)
    ).drop("__filled", "__empty", "__cells", "__ra", "__cb")
    return out.withColumn("p", chi2_sf("chi2", F.col("dof").cast("double"))) if with_p else out


def chi2_2x2(
    df: DataFrame, row: Column, col: Column, by: Sequence[str] = (), correction: bool = False,
    with_p: bool = True,
) -> DataFrame:
    """2x2 test of two conditions: cells, chi2 (Yates on request), Cramer's V, rate ratio."""
    def cell(x: Column, y: Column, name: str):
        return F.count(F.when(x & y, 1)).alias(name)

    t = df.groupBy(*by).agg(
        cell(row, col, "a"), cell(row, ~col, "b"), cell(~row, col, "c"), cell(~row, ~col, "d"))
    A, B, C, D = (F.col(x).cast("double") for x in "abcd")
    n = A + B + C + D
    gap = F.abs(A * D - B * C)
    if correction:
        gap = F.greatest(gap - n / 2, F.lit(0.0))
    denominator = (A + B) * (C + D) * (A + C) * (B + D)
    t = t.withColumn("chi2", F.when(denominator > 0, n * gap * gap / denominator))
    t = t.withColumn("cramers_v", F.sqrt(ratio(F.col("chi2"), n)))
    lift = F.when((C > 0) & (A + B > 0), (A / (A + B)) / (C / (C + D)))
    t = t.withColumn("enrichment", lift)
    return t.withColumn("p", chi2_sf("chi2", F.lit(1.0))) if with_p else t


def t_test(df: DataFrame, value: str, flag: Column, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Pooled two-sample t of flagged against other rows, and Cohen's d."""
    v = F.col(value).cast("double")
    one, two = F.when(flag, v), F.when(~flag, v)
    t = df.groupBy(*by).agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"),
        F.avg(one).alias("mean1"), F.avg(two).alias("mean2"),
        F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    sd = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    t = t.withColumn("__sd", F.when((n1 > 1) & (n2 > 1), sd)).drop("v1", "v2")
    gap = F.col("mean1") - F.col("mean2")
    t = t.withColumn("cohens_d", F.when(F.col("__sd") > 0, gap / F.col("__sd")).when(F.col("__sd") == 0, 0.0))
    scale = F.col("__sd") * F.sqrt(F.lit(1.0) / n1 + F.lit(1.0) / n2)
    t = t.withColumn("t", F.when(F.col("__sd") > 0, gap / scale)).drop("__sd")
    return t.withColumn("p", t_two_sided("t", (n1 + n2 - 2).cast("double"))) if with_p else t


def one_sample_t(df: DataFrame, value: str, mu: float, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    v = F.col(value).cast("double")
    t = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    t = t.withColumn("t", F.when(F.col("sd") > 0, (F.col("mean") - F.lit(mu)) / se))
    return t.withColumn("p", t_two_sided("t", (F.col("n") - 1).cast("double"))) if with_p else t


def fisher_p(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p") -> DataFrame:
    """One-sided (greater) Fisher exact p of each row's 2x2 table."""
    return df.withColumn(out, fisher_greater(a, b, c, d))


def mann_whitney(df: DataFrame, value: str, flag: Column, with_p: bool = True) -> DataFrame:
    """U of the flagged rows (average ranks for ties), rank-biserial correlation, one-sided p.

    Works on counts per value and running counts, so no task sorts the table.
    """
    per = df.where(F.col(value).isNotNull() & flag.isNotNull()).groupBy(F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(flag, 1)).alias("n1"))
    cum = running_totals(per, "value", {"n": "cum"})
    rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    t = cum.agg(
        F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"),
        F.sum(rank * F.col("n1")).alias("__r1"), F.sum(n * n * n - n).alias("__ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    t = t.withColumn("u", F.col("__r1") - n1 * (n1 + 1) / 2)
    t = t.withColumn("rank_biserial", ratio(F.lit(2.0) * F.col("u"), n1 * n2) - 1)
    N = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (N + 1 - ratio(F.col("__ties"), N * (N - 1))))
    t = t.withColumn("z", ratio(F.col("u") - n1 * n2 / 2 - F.lit(0.5), sd)).drop("__r1", "__ties")
    return t.withColumn("p", normal_sf("z")) if with_p else t


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, Spearman, RMSE and MAE of two columns.

    Distinct pairs are counted once; the margins are ranked from those counts, and everything else
    is a weighted sum over pairs, taken around the means so that large counts do not cancel.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pairs = materialize(pairs)
    average = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    d = pairs
    for c in ("a", "b"):
        ranks = value_ranks(pairs, c, weight="w").withColumn(f"rank_{c}", average)
        d = rank_join(d, c, ranks, [f"rank_{c}"])
    cols = ["a", "b", "rank_a", "rank_b"]
    d = materialize(d)
    n = F.sum("w").cast("double")
    means = d.agg(*[ratio(F.sum(F.col("w") * F.col(c)), n).alias(f"m_{c}") for c in cols])
    e = {c: F.col(c) - F.col(f"m_{c}") for c in cols}

    def correlation(x: str, y: str) -> Column:
        w = F.col("w")
        return ratio(F.sum(w * e[x] * e[y]), F.sqrt(F.sum(w * e[x] * e[x])) * F.sqrt(F.sum(w * e[y] * e[y])))

    gap = F.col("a") - F.col("b")
    return d.join(F.broadcast(means)).agg(  # one row
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        correlation("a", "b").alias("pearson"),
        correlation("rank_a", "rank_b").alias("spearman"),
        F.sqrt(ratio(F.sum(F.col("w") * gap * gap), n)).alias("rmse"),
        ratio(F.sum(F.col("w") * F.abs(gap)), n).alias("mae"),
    )


def corr_ci(df: DataFrame, r: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """Fisher-z 95 % interval of a correlation."""
    mid, half = F.atanh(r), ratio(F.lit(z), F.sqrt(F.col(n) - 3))
    return df.withColumn("ci_lo", F.tanh(mid - half)).withColumn("ci_hi", F.tanh(mid + half))


# Cumulative probabilities of a Poisson(1) count (fixed values of the distribution).
POISSON_1 = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.9999988747974020, 0.9999998885745217,
]


def _interval(reps: DataFrame, point: DataFrame, by: Sequence[str], ci: float) -> DataFrame:
    """Percentile interval; ``reps`` holds one row per replicate, so the list is bounded by B."""
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    q = reps.groupBy(*by).agg(
        F.percentile("value", F.lit(lo)).alias("ci_lo"),
        F.percentile("value", F.lit(hi)).alias("ci_hi"))
    out = point.join(q, list(by), "left") if by else point.join(F.broadcast(q))  # one row
    return out.withColumn("ci_width", F.col("ci_hi") - F.col("ci_lo"))


def bootstrap_mean(
    df: DataFrame, col: str, B: int = 1000, by: Sequence[str] = (), ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Poisson bootstrap interval of a mean.

    Equal values of a group are counted first: their weights add up to one Poisson(count) draw, fixed
    by the group and the value. A batch of values is summed for all replicates in one pass, so the
    shuffle carries one row per batch, group and replicate.
    """
    by = list(by)
    d = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__v"))
    cells = materialize(d.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    keyed = cells.select(group.alias("g"), "__v", "__n", F.xxhash64(group, "__v", F.lit(seed)).alias("k"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, names = pd.factorize(batch["g"])
            total, value = np.zeros((len(names), B)), np.zeros((len(names), B))
            for at in range(0, len(batch), 2048):
                part = slice(at, at + 2048)
                w = _weights(batch["k"].to_numpy()[part], batch["__n"].to_numpy()[part], B)
                np.add.at(total, code[part], w)
                np.add.at(value, code[part], w * batch["__v"].to_numpy()[part, None])
            yield pd.DataFrame({"g": np.repeat(names, B), "b": np.tile(np.arange(B, dtype=np.int32), len(names)),
                                "w": total.ravel(), "wv": value.ravel()})

    reps = keyed.mapInPandas(sums, "g string, b int, w double, wv double").groupBy("g", "b").agg(
        ratio(F.sum("wv"), F.sum("w")).alias("value"))
    n = F.sum("__n")
    point = cells.groupBy(*by).agg(
        ratio(F.sum(F.col("__v") * F.col("__n")), n.cast("double")).alias("point"), n.alias("n"), F.first(group).alias("g"))
    return _interval(reps, point, ["g"], ci).drop("g")


def _metrics_from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "mcc": div(tp * tn - fp * fn, margins),
        "accuracy": div(tp + tn, tp + tn + fp + fn),
        "precision": div(tp, tp + fp),
        "recall": div(tp, tp + fn),
        "f1": div(2 * tp, 2 * tp + fp + fn),
    }


def auc_by(scored: DataFrame, by: Sequence[str] = (), ready: bool = False) -> DataFrame:
    """AUC per group from ``score, wp, wn`` (weights of positives and negatives per score)."""
    cum = running_totals(scored, "score", {"wn": "__cn"}, by, ready=ready)
    wins = F.col("wp") * (F.col("__cn") - F.col("wn") / 2)
    return cum.groupBy(*by).agg(
        F.when((F.sum("wp") > 0) & (F.sum("wn") > 0), F.sum(wins) / (F.sum("wp") * F.sum("wn")))
        .alias("value"))


def _weights(keys: np.ndarray, counts: np.ndarray, B: int) -> np.ndarray:
    """Sum of ``count`` Poisson(1) weights per row and replicate, fixed by the row's key.

    Single rows use the inverse distribution on a mixed 64-bit key; tied rows draw
    Poisson(count) from a generator seeded by the key.
    """
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.arange(1, B + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    out = np.searchsorted(POISSON_1, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(float)
    out[counts == 0] = 0.0
    for i in np.flatnonzero(counts > 1):
        out[i] = np.random.default_rng(int(keys[i]) & (2**63 - 1)).poisson(counts[i], B)
    return out


def bootstrap_metric(
    df: DataFrame, y: str, p: str, metric: str | Callable[..., Column] = "auc", B: int = 1000,
    stratify: bool = False, threshold: float = 0.5, ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Poisson bootstrap interval of a binary metric: auc, accuracy, precision, recall, f1, mcc, or a
    function of four columns (tp, fp, fn, tn) to a column.

    Rows are first counted per score and class: the weights of c equal rows add up to one
    Poisson(c) draw, so ties cost one row and threshold metrics need four. For the AUC, scores
    are split into value buckets; each bucket returns its sums per replicate, and earlier
    buckets are added as offsets. ``stratify`` rescales the weights so that each class keeps
    its size. A replicate with one class counts as the point.
    """
    score = F.col(p).cast("double")
    if metric != "auc":
        score = (score >= threshold).cast("double")
    cells = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(score.alias("score")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("wp"), F.count(F.when(F.col(y) != 1, 1)).alias("wn"))
    cells = materialize(cells)
    n = cells.count()
    key = lambda c: F.xxhash64("score", F.lit(c), F.lit(seed))
    keyed = cells.withColumn("kp", key(1)).withColumn("kn", key(0))
    if metric == "auc":
        buckets = int(max(8, n // 20_000))
        keyed = value_buckets(keyed, "score", "bucket", buckets)
    else:
        keyed = keyed.withColumn("bucket", F.col("score").cast("int"))

    def replicate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        pos, neg, wins = np.zeros(B), np.zeros(B), np.zeros(B)
        for at in range(0, len(pdf), 2048):
            part = pdf.iloc[at : at + 2048]
            wp = _weights(part["kp"].to_numpy(), part["wp"].to_numpy(), B)
            wn = _weights(part["kn"].to_numpy(), part["wn"].to_numpy(), B)
            below = neg + np.cumsum(wn, axis=0) - wn / 2
            wins += (wp * below).sum(axis=0)
            pos += wp.sum(axis=0)
            neg += wn.sum(axis=0)
        return pd.DataFrame({"bucket": int(pdf["bucket"].iloc[0]), "b": np.arange(B, dtype=np.int32),
                             "wp": pos, "wn": neg, "wins": wins})

    reps = keyed.groupBy("bucket").applyInPandas(
        replicate, "bucket int, b int, wp double, wn double, wins double")
    if metric == "auc":
        point = auc_by(cells, ready=True).withColumnRenamed("value", "point")
        # One row per bucket and replicate.
        w = Window.partitionBy("b").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("wn").over(w), F.lit(0.0))
        total = reps.withColumn("wins", F.col("wins") + F.col("wp") * before).groupBy("b").agg(
            F.sum("wins").alias("wins"), F.sum("wp").alias("P"), F.sum("wn").alias("N"))
        both = (F.col("P") > 0) & (F.col("N") > 0)
        values = total.select("b", F.when(both, F.col("wins") / (F.col("P") * F.col("N"))).alias("value"))
    else:
        def measure(t: DataFrame, by: Sequence[str], flag: Column, scale: bool) -> DataFrame:
            part = lambda c, cond, name: F.sum(F.when(cond, F.col(c)).otherwise(0.0)).alias(name)
            s = t.groupBy(*by).agg(
                part("wp", flag, "tp"), part("wn", flag, "fp"), part("wp", ~flag, "fn"), part("wn", ~flag, "tn"))
            tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
            if scale:
                size = cells.agg(F.sum("wp").alias("P"), F.sum("wn").alias("N"))
                s = s.join(F.broadcast(size))  # one row
                kp, kn = ratio(F.col("P"), tp + fn), ratio(F.col("N"), fp + tn)
                tp, fn, fp, tn = tp * kp, fn * kp, fp * kn, tn * kn
            value = metric(tp, fp, fn, tn) if callable(metric) else _metrics_from_counts(tp, fp, fn, tn)[metric]
            return s.select(*by, value.cast("double").alias("value"))

        point = measure(cells, [], F.col("score") == 1.0, False).withColumnRenamed("value", "point")
        values = measure(reps, ["b"], F.col("bucket") == 1, stratify)
    filled = values.join(F.broadcast(point)).withColumn("value", F.coalesce("value", "point"))  # one row
    out = _interval(filled.select("value"), point, [], ci)
    name = getattr(metric, "__name__", "metric") if callable(metric) else metric
    return out.select(F.lit(name).alias("metric"), "point", "ci_lo", "ci_hi", "ci_width")


def bootstrap_proportion(
    df: DataFrame, p: str, n: str, B: int = 1000, by: Sequence[str] = (), ci: float = 0.95, seed: int = 42
) -> DataFrame:
    """Interval of a proportion from B normal draws of the binomial law, per row of ``df``."""
    keys = list(by)
    r = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))

    def uniform(n: int) -> Column:
        text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys],
                           F.col("b").cast("string"), F.lit(str(n)))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))

    u1, u2 = uniform(seed), uniform(seed + 1)
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0) * F.pi() * u2)
    draw = F.col(p) + z * F.sqrt(F.col(p) * (F.lit(1.0) - F.col(p)) / F.col(n))
    reps = r.withColumn("value", F.least(F.greatest(draw, F.lit(0.0)), F.lit(1.0)))
    point = df.select(*keys, F.col(p).alias("point"), n)
    return _interval(reps, point, keys, ci)


def z_test(df: DataFrame, x: str, mu: float, se: str, with_p: bool = True) -> DataFrame:
    z = df.withColumn("z", ratio(F.col(x) - F.lit(mu), F.col(se)))
    return z.withColumn("p", normal_two_sided("z")) if with_p else z


def bh_adjust(
    df: DataFrame, p: str = "p_raw", alpha: float = 0.05, by: Sequence[str] = (), monotone: bool = True
) -> DataFrame:
    """Benjamini-Hochberg adjusted p and rejection, exact on any number of tests.

    Equal p-values share the largest rank; adjusted = min over larger p of p n / rank.
    ``monotone=False`` gives the plain p n / rank.
    """
    by = list(by)
    ranks = value_ranks(df, p, by)
    ranks = ranks.withColumn("__raw", F.least(F.lit(1.0), F.col("value") * F.col("total") / F.col("cum")))
    ranks = materialize(ranks)
    stepped = running_totals(ranks, "value", {"__raw": "__step"}, by, descending=True, fn="min", ready=True)
    adjusted = stepped.select(
        *by, F.col("value").alias(p), F.col("__step" if monotone else "__raw").alias("p_bh_adjusted"),
        (F.col("__step") <= alpha).alias("reject"), "n", "total")
    if by:
        return dim_join(df, adjusted.drop("n", "total"), [*by, p], "left")
    return rank_join(df, p, adjusted.withColumnRenamed(p, "value"), ["p_bh_adjusted", "reject"])


def origin_slope_test(
    df: DataFrame, t: Column, d: Column, w: Column | None = None, by: Sequence[str] = (), with_p: bool = True
) -> DataFrame:
    """t statistic of a weighted slope through the origin, from sums."""
    w = F.lit(1.0) if w is None else w
    s = df.groupBy(*by).agg(
        ratio(F.sum(w * t * d), F.sum(w * t * t)).alias("slope"), F.count(d).alias("n"),
        F.sum(t * t).alias("__tt"), F.var_pop(d).alias("__vd"), F.covar_pop(t, d).alias("__vtd"),
        F.var_pop(t).alias("__vt"))
    m = F.col("slope")
    # Variance of d - m t, from moments around the means.
    sd = F.sqrt(F.greatest(F.col("__vd") - 2 * m * F.col("__vtd") + m * m * F.col("__vt"), F.lit(0.0)))
    s = s.withColumn("se", sd / (F.sqrt("__tt") + F.lit(1e-9)))
    s = s.withColumn("t", m / (F.col("se") + F.lit(1e-9)))
    s = s.drop("__tt", "__vd", "__vtd", "__vt")
    return s.withColumn("p", t_two_sided("t", (F.col("n") - 1).cast("double"))) if with_p else s


def split_at_quantile(
    df: DataFrame, col: str, q: float = 0.5, by: Sequence[str] = (), out: str = "is_high"
) -> DataFrame:
    """Flag rows above an exact quantile (of their group)."""
    cut = exact_quantiles(df, col, {"__cut": q}, by)
    j = dim_join(df, cut, list(by)) if by else df.join(F.broadcast(cut))  # one row
    return j.withColumn(out, F.col(col) > F.col("__cut")).drop("__cut")


def control_check(
    series: DataFrame, start: int, value: str = "mean_distance", n: str = "sample_size",
    by: Sequence[str] = (), alpha: float = 0.05,
) -> DataFrame:
    """Positive and negative control on a period series: drift after ``start``, none before.

    After: weighted slope through the origin of t = period - start. Before: plain slope.
    """
    t = (F.col("period") - F.lit(start)).cast("double")
    after = origin_slope_test(
        series.where(F.col("period") >= start), t, F.col(value), F.col(n).cast("double"), by)
    before = linear_trend(series.where(F.col("period") < start), "period", value, by)
    a = after.select(*by, F.col("slope").alias("slope_after"), F.col("p").alias("p_after"))
    b = before.select(*by, F.col("slope").alias("slope_before"), F.col("p").alias("p_before"))
    j = a.join(b, list(by), "left") if by else a.join(F.broadcast(b))  # one row each
    drift = (F.col("slope_after") > 0) & (F.col("p_after") < alpha)
    flat = F.coalesce(F.col("p_before") >= alpha, F.lit(True))
    return j.withColumn("positive_control", drift).withColumn("negative_control", flat)


def late_enrichment(
    df: DataFrame, value: str, late: Column, by: Sequence[str] = (), q: float = 0.5, with_p: bool = True
) -> DataFrame:
    """Whether high rows (above a quantile of their group) are late more often than the others: the
    third part of the control, as a 2x2 test without correction."""
    high = split_at_quantile(df.where(F.col(value).isNotNull()), value, q, by, "__high")
    return chi2_2x2(high, F.col("__high"), late, by, with_p=with_p)


def audit_table(parts: Sequence[DataFrame], digits: int = 4) -> DataFrame:
    """Stack ``test, point, ci_lo, ci_hi, effect`` rows and add a formatted text."""
    out = None
    for part in parts:
        part = part.select("test", "point", "ci_lo", "ci_hi", "effect")
        out = part if out is None else out.unionByName(part)
    pattern = f"%.{digits}f [95%% CI: %.{digits}f, %.{digits}f]"
    text = F.format_string(pattern, "point", "ci_lo", "ci_hi")
    return out.withColumn("text", F.when(F.col("ci_lo").isNull(), F.lit("N/A")).otherwise(text))


def baseline_distance(
    df: DataFrame, key: Sequence[str], order: str, metrics: Sequence[str], threshold: float = 0.15
) -> DataFrame:
    """Euclidean distance of each metric vector to the first one of its entity, and drift flag.

    The first vector is one aggregated row per entity, so long series are not sorted.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(order, *metrics)).alias("__f"))
    j = dim_join(df, first, key) if key else df.join(F.broadcast(first))  # one row
    total = F.lit(0.0)
    for m in metrics:
        gap = F.col(m) - F.col("__f")[m]
        total = total + gap * gap
    j = j.withColumn("distance", F.sqrt(total)).drop("__f")
    return j.withColumn("drift", (F.col("distance") > threshold).cast("int"))


def cluster_agreement(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Macro-F1 (equal label names) and adjusted Rand index from the contingency counts."""
    cells = materialize(df.groupBy(F.col(truth).alias("a"), F.col(found).alias("b")).agg(
        F.count(F.lit(1)).alias("n")))
    choose = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    pairs = lambda c: F.sum(choose(c))
    a = cells.groupBy("a").agg(F.sum("n").alias("n_a"))
    b = cells.groupBy("b").agg(F.sum("n").alias("n_b"))
    hit = cells.where(F.col("a") == F.col("b")).select(F.col("a").alias("label"), F.col("n").alias("tp"))
    labels = a.withColumnRenamed("a", "label").join(b.withColumnRenamed("b", "label"), "label", "full")
    labels = labels.join(hit, "label", "left").na.fill(0, ["n_a", "n_b", "tp"])
    f1 = labels.agg(F.avg(2 * F.col("tp") / (F.col("n_a") + F.col("n_b"))).alias("macro_f1"))
    s = cells.agg(pairs("n").alias("ij"), F.sum("n").alias("n"))
    one = s.join(F.broadcast(a.agg(pairs("n_a").alias("i")))).join(
        F.broadcast(b.agg(pairs("n_b").alias("j")))).join(F.broadcast(f1))  # one row each
    expected = ratio(F.col("i") * F.col("j"), choose("n"))
    top = F.col("ij") - expected
    bottom = (F.col("i") + F.col("j")) / 2 - expected
    ari = F.coalesce(ratio(top, bottom), F.lit(1.0))
    return one.select("n", "macro_f1", ari.alias("adjusted_rand"))
