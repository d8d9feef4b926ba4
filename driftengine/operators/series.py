"""Period series: aggregates, spines, changes, cumulative counts, trends and forecasts.

A period series has one row per (group, period); it is an aggregate and small per group, so
windows over it are cheap. Raw rows are always aggregated before any window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.functions.columns import ratio
from driftengine.functions.tails import t_two_sided
from driftengine.operators.sequence import VARIANT
from driftengine.scale import dim_join, materialize, most_frequent, range_join


def _by(group: Sequence[str]):
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))


def divergence_by_period(
    df: DataFrame, group: Sequence[str] = ("grp",), lineage: Column | None = None
) -> DataFrame:
    """Mean, sd and count of ``distance`` per period, for all rows and for a lineage, in one pass."""
    keep = F.lit(True) if lineage is None else lineage
    inside = F.when(keep, F.col("distance"))
    return df.groupBy(*group, "period").agg(
        F.avg("distance").alias("mean_distance"),
        F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("std_distance"),
        F.count("distance").alias("sample_size"),
        F.avg(inside).alias("lineage_mean"),
        F.count(inside).alias("lineage_n"),
    )


def period_rate(
    events: DataFrame, records: DataFrame, lo: int, hi: int, flag: str = "in_region",
    group: Sequence[str] = ("grp",),
) -> DataFrame:
    """Records, records with a flagged event and their percentage per period, zero-filled.

    Both counts are of records and of the same group, so the percentage stays within 0..100.
    """
    keys = [*group, "period"]
    rows = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sequences"))
    hits = events.where(F.col(flag)).select(*keys, "id").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_flagged"))
    groups = records.select(*group).distinct()
    spine = groups.withColumn("period", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    out = spine.join(rows, keys, "left").join(hits, keys, "left").na.fill(
        0, ["n_sequences", "n_flagged"])
    pct = F.when(F.col("n_sequences") > 0, F.col("n_flagged") * 100.0 / F.col("n_sequences"))
    return out.withColumn("pct", F.coalesce(pct, F.lit(0.0)))


def accelerations(
    df: DataFrame, value: str, group: Sequence[str] = (), plateau: float = 0.3
) -> DataFrame:
    """Change to the previous period; accelerating above one sd of the changes, plateau within
    0.3 sd, and the peak and lowest period."""
    w = _by(group)
    d = df.withColumn("change", F.col(value) - F.lag(value).over(w.orderBy("period")))
    d = d.withColumn("__sd", F.stddev_samp("change").over(w))
    d = d.withColumn("__top", F.max_by("period", F.struct(value, -F.col("period"))).over(w))
    d = d.withColumn("__low", F.min_by("period", F.struct(value, "period")).over(w))
    no = F.lit(False)
    return (
        d.withColumn("accelerating", F.coalesce(F.col("change") > F.col("__sd"), no))
        .withColumn("plateau", F.coalesce(F.abs("change") <= F.col("__sd") * plateau, no))
        .withColumn("is_peak", F.col("period") == F.col("__top"))
        .withColumn("is_low", F.col("period") == F.col("__low"))
        .drop("__sd", "__top", "__low")
    )


def _variants_seen(events: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    return events.select(*group, "period", *key).distinct()


def period_features(
    events: DataFrame, group: Sequence[str] = ("grp",), key: Sequence[str] = ("position", "var_char"),
    flag: str = "in_region",
) -> DataFrame:
    """Per period: events, flagged events, keys absent from the previous period, mean position,
    flagged share and the entropy (nats) of the flagged symbols (0 for two events or fewer).

    A period whose predecessor has no events counts all its events as new.
    """
    keys = [*group, "period"]
    base = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col(flag).cast("long")).alias("n_flagged"),
        F.avg("position").alias("mean_position"),
    )
    seen = _variants_seen(events, group, key)
    previous = seen.withColumn("period", F.col("period") + 1)
    new = seen.join(previous, [*keys, *key], "left_anti").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__new"))
    active = base.select(*group, (F.col("period") + 1).alias("period"), F.lit(1).alias("__prev"))
    c = F.col("c").cast("double")
    ent = events.where(F.col(flag)).groupBy(*keys, "var_char").agg(F.count(F.lit(1)).alias("c"))
    ent = ent.groupBy(*keys).agg(
        F.when(F.sum("c") > 2, F.log(F.sum("c")) - F.sum(c * F.log(c)) / F.sum("c"))
        .otherwise(0.0).alias("entropy"))
    out = base.join(new, keys, "left").join(active, keys, "left").join(ent, keys, "left")
    fresh = F.when(F.col("__prev").isNull(), F.col("n_events")).otherwise(
        F.coalesce("__new", F.lit(0)))
    return out.select(
        *keys, "n_events", "n_flagged", fresh.alias("n_new"), "mean_position",
        (F.col("n_flagged") / F.col("n_events")).alias("frac_flagged"),
        F.greatest(F.lit(0.0), F.coalesce("entropy", F.lit(0.0))).alias("entropy"),
    )


def cumulative_distinct(
    events: DataFrame, group: Sequence[str] = ("grp",), key: Sequence[str] = ("position", "var_char")
) -> DataFrame:
    """Distinct keys seen up to each period: a key counts in its first period only."""
    first = events.groupBy(*group, *key).agg(F.min("period").alias("period"))
    n = first.groupBy(*group, "period").agg(F.count(F.lit(1)).alias("n_first_seen"))
    periods = events.select(*group, "period").distinct()
    filled = periods.join(n, [*group, "period"], "left").na.fill(0, ["n_first_seen"])
    w = _by(group).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("cumulative", F.sum("n_first_seen").over(w))


def population_features(
    df: DataFrame, position: int, alphabet: str, label: str, group: Sequence[str] = ("grp",)
) -> DataFrame:
    """Per period: mean normalised distance, mean length, distinct labels and the share of each
    alphabet symbol at one position. Needs ``distance`` and ``ref_length`` columns."""
    symbol = F.substring("sequence", position + 1, 1)
    inside = symbol.isin(list(alphabet))
    share = [
        F.coalesce(ratio(F.count(F.when(symbol == s, 1)), F.count(F.when(inside, 1))), F.lit(0.0)).alias(f"share_{s}")
        for s in alphabet
    ]
    return df.groupBy(*group, "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ratio(F.col("distance"), F.col("ref_length"))).alias("mean_distance"),
        F.avg(F.length("sequence")).alias("mean_length"),
        F.countDistinct(label).alias("n_labels"),
        *share,
    )


def next_label(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    w = _by(group).orderBy("period")
    return df.withColumn("next_period", F.lead("period").over(w)).withColumn(
        f"next_{label}", F.lead(label).over(w))


def dominant(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Most frequent label per period, smallest on ties."""
    return most_frequent(
        df.where(F.col(label).isNotNull()), [*group, "period"], label, "dominant", "n_dominant")


def persistence(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Forecast of a period's dominant label by the one of the period before, and whether it hit."""
    d = dominant(df, label, group)
    w = _by(group).orderBy("period")
    previous = F.when(F.lag("period").over(w) == F.col("period") - 1, F.lag("dominant").over(w))
    out = d.withColumn("forecast", previous).where(F.col("forecast").isNotNull())
    return out.withColumn("hit", (F.col("forecast") == F.col("dominant")).cast("int"))


def adaptive_forecast(
    df: DataFrame, targets: DataFrame, classes: Sequence[str], prob: str = "prob",
    widths: Sequence[int] = (4, 8, 15), min_n: int = 5, min_p: float = 0.40,
) -> DataFrame:
    """Class forecast per target period t from confident rows of [t - width + 1, t].

    The first width with at least ``min_n`` rows is used, else the widest. Rows are summed per
    period first, so the windows only join period sums. Without any row the overall mean is used.
    """
    sums = [F.sum(c).alias(c) for c in classes]
    confident = df.where(F.col(prob) > min_p).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), *sums)
    wide = targets.select(F.col("period").alias("t")).distinct().withColumn(
        "width", F.explode(F.array(*[F.lit(w) for w in widths])))
    wide = wide.withColumn("__lo", F.col("t") - F.col("width") + 1).withColumn("__hi", F.col("t") + 1)
    found = range_join(confident, "period", wide, "__lo", "__hi", how="inner").groupBy("t", "width").agg(
        F.sum("n").alias("n"), *sums)
    every = wide.select("t", "width").join(found, ["t", "width"], "left").na.fill(0)
    enough = F.when(F.col("n") >= min_n, F.col("width")).otherwise(F.lit(10 * max(widths)) - F.col("width"))
    pick = every.groupBy("t").agg(F.min_by(F.struct("width", "n", *classes), enough).alias("s"))
    overall = df.agg(*[F.avg(c).alias(f"__{c}") for c in classes])
    rows = pick.select("t", "s.*").join(F.broadcast(overall))  # one row
    value = [F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.col(f"__{c}")) for c in classes]
    total = sum(value[1:], value[0]) + F.lit(1e-12)
    best = F.greatest(*value)
    winner = F.coalesce(*[F.when(v == best, F.lit(i)) for i, v in enumerate(value)])
    return rows.select(
        F.col("t").alias("period"), F.when(F.col("n") > 0, F.col("width")).alias("width"), "n",
        winner.alias("forecast"), (best / total).alias("confidence"))


def concordance(df: DataFrame, predicted: str, actual: str, era: Sequence[str] = ()) -> DataFrame:
    """Share of exact and within-one-step forecasts and the mean step distance."""
    gap = F.abs(F.col(predicted) - F.col(actual))
    return df.groupBy(*era).agg(
        F.count(gap).alias("n"),
        F.avg((gap == 0).cast("double")).alias("exact"),
        F.avg((gap <= 1).cast("double")).alias("within_one"),
        F.avg(gap).alias("mean_steps"),
    )


def precision_at_k(
    pred: DataFrame, truth: DataFrame, k: int, keys: Sequence[str], score: str = "score"
) -> DataFrame:
    """Share of a period's k best keys that are in the truth set of the period."""
    order = [F.col(score).desc(), *[F.col(c) for c in keys]]
    best = pred.withColumn("__rn", F.row_number().over(Window.partitionBy("period").orderBy(*order)))
    best = best.where(F.col("__rn") <= k).select("period", *keys)
    hits = best.join(truth.select("period", *keys), ["period", *keys], "left_semi")
    n = hits.distinct().groupBy("period").agg(F.count(F.lit(1)).alias("hits"))
    return pred.select("period").distinct().join(n, "period", "left").na.fill(0, ["hits"]).withColumn(
        "precision_at_k", F.col("hits") / F.lit(k))


def key_trends(
    df: DataFrame, key: Sequence[str] = tuple(VARIANT), value: str = "frequency", min_n: int = 4,
    alpha: float = 0.05, with_p: bool = True,
) -> DataFrame:
    """Slope of a frequency over periods per key with minimum support; start and end values."""
    x, y = F.col("period").cast("double"), F.col(value)
    t = df.where(y.isNotNull()).groupBy(*key).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n_periods"),
        F.min_by(value, "period").alias("start"), F.max_by(value, "period").alias("end"),
    ).where(F.col("n_periods") >= min_n)
    if not with_p:
        return t
    n = F.col("n_periods").cast("double")
    stat = F.when(F.col("r2") < 1, F.sqrt(F.col("r2") * (n - 2) / (F.lit(1.0) - F.col("r2"))))
    t = t.withColumn("p", F.when(F.col("r2") >= 1, 0.0).otherwise(t_two_sided(stat, n - 2)))
    sure = F.coalesce(F.col("p") < alpha, F.lit(False))
    return t.withColumn("accelerating", (F.col("slope") > 0) & sure).withColumn(
        "decelerating", (F.col("slope") < 0) & sure)


def poly_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = (), limit: float = 0.001) -> DataFrame:
    """Quadratic least squares y = c2 x^2 + c1 x + c0 per group, R2 and trajectory class.

    Normal equations from power sums of x - mean(x), solved in closed form.
    """
    by = list(by)
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    mean = d.groupBy(*by).agg(F.avg(x).alias("__m"))
    d = dim_join(d, mean, by) if by else d.join(F.broadcast(mean))  # one row
    u, v = F.col(x) - F.col("__m"), F.col(y).cast("double")
    s = d.groupBy(*by, "__m").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"),
        F.sum(v * v).alias("vv"),
    )
    n, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s2", "s3", "s4", "t0", "t1", "t2"))
    # The first power sum is zero after centring.
    det = n * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    a2 = (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / det
    s = s.withColumn("a2", F.when(det != 0, a2))
    s = s.withColumn("a1", ratio(t1 - F.col("a2") * s3, s2))
    s = s.withColumn("a0", (t0 - F.col("a2") * s2) / n)
    A2, A1, A0, m = F.col("a2"), F.col("a1"), F.col("a0"), F.col("__m")
    explained = A0 * t0 + A1 * t1 + A2 * t2
    total = F.col("vv") - t0 * t0 / n
    r2 = F.when(total > 0, F.lit(1.0) - (F.col("vv") - explained) / total)
    kind = F.when(A2 > limit, "Accelerating").when(A2 < -limit, "Decelerating").otherwise("Linear")
    return s.select(
        *by, "n", A2.alias("c2"), (A1 - 2 * A2 * m).alias("c1"),
        (A0 - A1 * m + A2 * m * m).alias("c0"), r2.alias("r2"), kind.alias("trajectory"))


def poly_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with quadratic fit, velocity (derivative) and residual."""
    by = list(by)
    fit = poly_fit(df, x, y, by).select(*by, "c2", "c1", "c0", "r2", "trajectory")
    j = dim_join(df, fit, by) if by else df.join(F.broadcast(fit))  # one row
    v = F.col(x)
    value = F.col("c2") * v * v + F.col("c1") * v + F.col("c0")
    return j.withColumn("poly_fit", value).withColumn(
        "velocity", 2 * F.col("c2") * v + F.col("c1")).withColumn(
        "residual", F.col(y) - F.col("poly_fit")).drop("c2", "c1", "c0")


def lag_windows(df: DataFrame, L: int, value: str, order: str = "period", by: Sequence[str] = ()) -> DataFrame:
    """The ``L`` values before each point as an array, for points that have them all."""
    w = _by(by).orderBy(order)
    past = F.collect_list(value).over(w.rowsBetween(-L, -1))
    return df.withColumn("window", past).where(F.size("window") == L)


def _ar1(df: DataFrame, value: str, order: str, by: Sequence[str], unit_root: float) -> DataFrame:
    """Per key: AR(1) on the level and on the differences, last values, and which to use."""
    w = _by(by).orderBy(order)
    d = df.withColumn("__l", F.lag(value).over(w)).withColumn("__z", F.col(value) - F.col("__l"))
    d = d.withColumn("__zl", F.lag("__z").over(w))

    def fit(y: str, x: str, name: str):
        y, x = F.col(y), F.col(x)
        s2 = ratio(F.regr_syy(y, x) * (F.lit(1.0) - F.regr_r2(y, x)), F.regr_count(y, x) - 2)
        return [F.regr_slope(y, x).alias(f"phi_{name}"), F.regr_intercept(y, x).alias(f"a_{name}"),
                s2.alias(f"s2_{name}")]

    t = d.groupBy(*by).agg(
        *fit(value, "__l", "level"), *fit("__z", "__zl", "diff"),
        F.max_by(value, order).alias("last"), F.max_by("__z", order).alias("last_diff"),
        F.max(order).alias("last_order"), F.count(value).alias("n"))
    return t.withColumn("d", (F.col("phi_level") >= unit_root).cast("int"))


def ar1_forecast(
    df: DataFrame, value: str, h: int = 5, order: str = "period", by: Sequence[str] = (),
    z: float = 1.959963984540054, unit_root: float = 0.95,
) -> DataFrame:
    """h-step AR(1) forecast with 95 % interval per key, on the level or (near a unit root) on
    the differences. Closed form; keys run in parallel."""
    t = _ar1(df, value, order, by, unit_root).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    diff = F.col("d") == 1
    phi = F.when(diff, F.col("phi_diff")).otherwise(F.col("phi_level"))
    a = F.when(diff, F.col("a_diff")).otherwise(F.col("a_level"))
    s2 = F.when(diff, F.col("s2_diff")).otherwise(F.col("s2_level"))
    t = t.withColumn("phi", phi).withColumn("a", a).withColumn("s2", s2)
    k, phi, a = F.col("step"), F.col("phi"), F.col("a")
    mu = ratio(a, F.lit(1.0) - phi)
    geometric = lambda r, m: ratio(F.lit(1.0) - F.pow(r, m), F.lit(1.0) - r)
    level = mu + F.pow(phi, k) * (F.col("last") - mu)
    level_var = F.col("s2") * geometric(phi * phi, k)
    moved = F.col("last") + mu * k + (F.col("last_diff") - mu) * phi * geometric(phi, k)
    psi = F.aggregate(
        F.sequence(F.lit(1), k), F.lit(0.0),
        lambda acc, j: acc + F.pow(geometric(phi, j), F.lit(2.0)))
    mean = F.when(diff, moved).otherwise(level)
    half = F.lit(z) * F.sqrt(F.when(diff, F.col("s2") * psi).otherwise(level_var))
    return t.select(
        *by, "last_order", "step", "d", mean.alias("forecast"),
        (mean - half).alias("ci_lower"), (mean + half).alias("ci_upper"))


def ar1_holdout(
    df: DataFrame, value: str, n_val: int = 3, order: str = "period", by: Sequence[str] = (),
    limit: float = 15.0,
) -> DataFrame:
    """MAE and MAPE of the forecast on the last ``n_val`` points per key; PASS below the limit."""
    w = _by(by).orderBy(F.col(order).desc())
    ranked = materialize(df.withColumn("__back", F.row_number().over(w)))
    fc = ar1_forecast(ranked.where(F.col("__back") > n_val), value, n_val, order, by)
    held = ranked.where(F.col("__back") <= n_val).withColumn("step", F.lit(n_val + 1) - F.col("__back"))
    gap = F.abs(F.col(value) - F.col("forecast"))
    out = held.join(fc.select(*by, "step", "forecast"), [*by, "step"]).groupBy(*by).agg(
        F.avg(gap).alias("mae"),
        (F.avg(F.abs((F.col(value) - F.col("forecast")) / (F.col(value) + F.lit(1e-9)))) * 100).alias("mape"))
    return out.withColumn("status", F.when(F.col("mape") < limit, "PASS").otherwise("FAIL"))


def rolling_mean(df: DataFrame, n: int, value: str, order: str = "period", by: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``n`` points, from the n-th point on."""
    w = _by(by).orderBy(order).rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(w) == n
    return df.withColumn("rolling_mean", F.when(full, F.avg(value).over(w)))


def lag_influence(df: DataFrame, L: int, value: str, order: str = "period", by: Sequence[str] = ()) -> DataFrame:
    """Correlation of a series with itself ``lag`` steps back, lags 1..L."""
    w = _by(by).orderBy(order)
    lagged = df.select(*by, value, *[F.lag(value, i).over(w).alias(f"l{i}") for i in range(1, L + 1)])
    wide = lagged.groupBy(*by).agg(*[F.corr(value, f"l{i}").alias(str(i)) for i in range(1, L + 1)])
    return wide.unpivot(list(by), [str(i) for i in range(1, L + 1)], "lag", "correlation").withColumn(
        "lag", F.col("lag").cast("int"))


def mean_class_forecast(
    df: DataFrame, classes: Sequence[str], start: int, prob: str = "prob", min_p: float = 0.5
) -> DataFrame:
    """Mean class probabilities of recent confident rows (all rows if none), renormalised; the
    largest is marked."""
    use = (F.col("period") >= start) & (F.col(prob) > min_p)
    t = df.agg(
        *[F.coalesce(F.avg(F.when(use, F.col(c))), F.avg(c)).alias(c) for c in classes])
    total = sum([F.col(c) for c in classes[1:]], F.col(classes[0]))
    best = F.greatest(*[F.col(c) for c in classes])
    winner = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in classes])
    t = t.select(*[ratio(F.col(c), total).alias(c) for c in classes], winner.alias("__w"))
    long = t.unpivot(["__w"], list(classes), "class", "probability")
    return long.select("class", "probability", (F.col("class") == F.col("__w")).alias("is_best"))
