"""Cross-validation and backtests end to end: fits per fold, out-of-fold scores, metrics, summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.functions.columns import ratio
from driftengine.operators.evaluate import auc_interval, binary_metrics, fold_summary
from driftengine.operators.models import predict
from driftengine.scale import dim_join, hash_rank, in_parallel, materialize

Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, Sequence[str]], "PipelineModel | Scorer"]
#: Smallest variance a feature may have in a class.
LEAST_VARIANCE = 1e-9


def fit_gaussian(df: DataFrame, features: Sequence[str], label: str = "label") -> Scorer:
    """Two normal distributions a feature, independent of each other: a classifier in closed form, from
    one pass of means and variances. Returns what adds ``prob`` of class 1 to rows."""
    stats = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        stats += [F.avg(f).alias(f"m{i}"), F.greatest(F.var_pop(f), F.lit(LEAST_VARIANCE)).alias(f"v{i}")]
    by = {r["__y"]: r for r in df.groupBy((F.col(label) == 1).alias("__y")).agg(*stats).collect()}  # two rows
    if not by.get(True) or not by.get(False):
        raise ValueError("both classes are needed")
    yes, no = by[True], by[False]
    z = F.log(F.lit(yes.n / no.n))
    for i, f in enumerate(features):
        side = lambda r: -F.lit(0.5) * F.log(F.lit(r[f"v{i}"])) - (F.col(f) - r[f"m{i}"]) * (  # noqa: B023,E731
            F.col(f) - r[f"m{i}"]) / F.lit(2 * r[f"v{i}"])
        z = z + side(yes) - side(no)
    return lambda rows: rows.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def _balanced(train: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of either class as the rarer one has, the first in hash order."""
    least = min(r[1] for r in train.groupBy(label).count().collect())  # one row a class
    return hash_rank(train, [label], key, quota=least).drop("rank", "total")


def cross_predict(
    df: DataFrame, features: Sequence[str], models: Mapping[str, Fit | Column], label: str = "label", key: str = "id",
    balanced: bool = False, min_class: int = 10, threads: int = 4,
) -> DataFrame:
    """One row per model and scored row: ``fold, model, key, label, prob``, every score by a model that
    was fitted without the row.

    ``df`` has a ``fold``: with a ``role`` too (``temporal_folds``), rows of the role train are fitted
    and those of the role test scored; without (``kfold``), each fold is scored by what the others
    give. ``models`` are fits or plain columns, which need none. Fits of folds and models run side by
    side, each on Spark. A fold whose training part has fewer than ``min_class`` rows of a class is
    left out; ``balanced`` takes as many rows of each class as the rarer one has.
    """
    df = df.persist()
    roles = "role" in df.columns
    group = ["fold", "role"] if roles else ["fold"]
    sizes = df.where(F.col(label).isNotNull()).groupBy(*group, (F.col(label) == 1).alias("__y")).count().collect()
    parts = []
    for fold in sorted({r.fold for r in sizes}):
        train = [r for r in sizes if (r.fold == fold and r.role == "train" if roles else r.fold != fold)]
        if all(sum(r["count"] for r in train if r["__y"] == y) >= min_class for y in (True, False)):
            parts.append(fold)
    known = df.where(F.col(label).isNotNull())

    def score(step) -> DataFrame:
        fold, (name, fit) = step
        if roles:
            mine = known.where(F.col("fold") == fold)
            train, test = mine.where("role = 'train'"), mine.where("role = 'test'")
        else:
            train, test = known.where(F.col("fold") != fold), known.where(F.col("fold") == fold)
        if isinstance(fit, Column):
            got = test.withColumn("prob", fit.cast("double"))
        else:
            model = fit(_balanced(train, label, key) if balanced else train, features)
            got = model(test) if not hasattr(model, "transform") else predict(model, test)
        return got.select("fold", F.lit(name).alias("model"), key, label, "prob")

    steps = [(fold, item) for fold in parts for item in models.items()]
    scored = in_parallel(score, steps, threads)
    if not scored:
        schema = f"fold {df.schema['fold'].dataType.simpleString()}, model string, {key} " \
                 f"{df.schema[key].dataType.simpleString()}, {label} {df.schema[label].dataType.simpleString()}, prob double"
        return df.sparkSession.createDataFrame([], schema)
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    out = materialize(out)
    df.unpersist()
    return out


def fold_metrics(scored: DataFrame, label: str = "label", level: float = 0.95) -> DataFrame:
    """Per fold and model the metrics of ``binary_metrics`` and the AUC's interval."""
    by = ["fold", "model"]
    interval = auc_interval(scored, label, "prob", level, by).select(*by, "n_pos", "n_neg", "auc_lo", "auc_hi")
    return binary_metrics(scored, label, "prob", by=by).join(interval, by)


def cv_summary(metrics: DataFrame, names: Sequence[str] = ("auc", "f1", "accuracy")) -> DataFrame:
    """Mean and sample sd over the folds, per model."""
    return fold_summary(metrics, "model", list(names))


def prefix_backtest(
    df: DataFrame, features: Sequence[str], label: str, min_train: int = 2, period: str = "period"
) -> DataFrame:
    """Forecast of every row's class by a linear discriminant of all earlier periods: the columns of
    ``df``, ``n_train`` (earlier periods), ``forecast`` and ``hit``.

    Counts, sums and sums of squares are taken once per period and class; running totals over the
    periods are the statistics of every cut, so no cut is fitted again. The discriminant has one
    variance a feature, pooled over the classes, and no covariances; the largest score wins, the
    smallest label on ties. Periods with fewer than ``min_train`` before them, or one class only, have
    no forecast. Rows with a null label or feature take no part.
    """
    known = df.where(F.col(label).isNotNull())
    for f in features:
        known = known.where(F.col(f).isNotNull())
    # Sums of squares are taken around the overall mean, which keeps their digits.
    centre = known.agg(*[F.avg(f).alias(f) for f in features]).first()
    moved = {f: F.col(f) - F.lit(float(centre[f] or 0.0)) for f in features}
    stats = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        stats += [F.sum(moved[f]).alias(f"s{i}"), F.sum(moved[f] * moved[f]).alias(f"q{i}")]
    per = materialize(known.groupBy(F.col(period).alias("__t"), F.col(label).alias("__c")).agg(*stats))
    # Periods x classes, however many rows there are.
    grid = per.select("__t").distinct().join(per.select("__c").distinct(), how="cross").join(per, ["__t", "__c"], "left")
    before = Window.partitionBy("__c").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    sums = [f"{k}{i}" for i in range(len(features)) for k in "sq"]
    cut = grid.select("__t", "__c", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", *sums)],
                      (F.dense_rank().over(Window.partitionBy("__c").orderBy("__t")) - 1).alias("n_train"))
    whole = Window.partitionBy("__t")
    cut = cut.where("n > 0").withColumn("__all", F.sum("n").over(whole)).withColumn("__k", F.count(F.lit(1)).over(whole))
    for i in range(len(features)):
        inside = F.sum(F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")).over(whole)
        freedom = F.greatest(F.col("__all") - F.col("__k"), F.lit(1))
        cut = cut.withColumn(f"v{i}", F.greatest(inside / freedom, F.lit(LEAST_VARIANCE))).withColumn(
            f"m{i}", F.col(f"s{i}") / F.col("n"))
    models = materialize(cut.where((F.col("n_train") >= min_train) & (F.col("__k") > 1)).drop(*sums))
    columns = df.columns
    rows = known.withColumn("__t", F.col(period))
    # One score a class: a row's scores stay with it in an array, so rows are not shuffled.
    lists = models.groupBy("__t").agg(F.max("n_train").alias("n_train"), F.sort_array(F.collect_list(F.struct(
        "__c", "n", "__all", *[f"{k}{i}" for i in range(len(features)) for k in "mv"]))).alias("__classes"))

    def value(c: Column) -> Column:
        total = F.log(c["n"] / c["__all"])
        for i, f in enumerate(features):
            gap = moved[f] - c[f"m{i}"]
            total = total - gap * gap / (F.lit(2.0) * c[f"v{i}"])
        return F.struct((-total).alias("s"), c["__c"].alias("c"))

    joined = dim_join(rows, lists, ["__t"])
    forecast = F.array_min(F.transform("__classes", value))["c"]
    out = joined.withColumn("forecast", forecast)
    return out.withColumn("hit", (F.col("forecast") == F.col(label)).cast("int")).select(
        *columns, F.col("n_train").cast("int").alias("n_train"), "forecast", "hit")


def hit_rates(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_transitions"), F.sum("hit").alias("n_correct"),
        ratio(F.sum("hit"), F.count(F.lit(1))).alias("hit_rate"))
