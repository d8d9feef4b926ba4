"""Features, clustering, classifiers and anomaly scores on ``pyspark.ml``.

Loops run over a handful of models, folds or column sets; the data of each fit stays on Spark.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftengine.operators.evaluate import auc_difference, auc_interval, binary_metrics
from driftengine.scale import exact_quantiles, in_parallel, materialize, shared_dir

SEED = 42
#: Rows of a bucket in which values are permuted.
PERMUTED_ROWS = 100_000
#: Tables of fewer rows are not dealt over the cores before trees are fitted.
TREE_ROWS = 100_000


def _features(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """Add ``features``: assembled columns, or one array column turned into a vector."""
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return assembler.transform(df)


def _scaled(df: DataFrame) -> tuple[object, DataFrame]:
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(df)
    return model, model.transform(df)


def pca_keep(df: DataFrame, features: Sequence[str] | str, share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Standardised principal components that keep a share of the variance.

    Returns the rows with ``pca`` and the table ``component, explained, cumulative, kept``.
    """
    _, scaled = _scaled(_features(df, features))
    size = len(scaled.select("scaled").first()[0])
    model = PCA(k=size, inputCol="scaled", outputCol="__all").fit(scaled)
    explained = model.explainedVariance.toArray()
    kept = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    kept = min(kept, size)
    rows = VectorSlicer(inputCol="__all", outputCol="pca", indices=list(range(kept))).transform(
        model.transform(scaled)).drop("__all", "scaled", "features")
    table = df.sparkSession.createDataFrame(
        [(i + 1, float(e), float(c), i < kept) for i, (e, c) in enumerate(zip(explained, np.cumsum(explained)))],
        "component int, explained double, cumulative double, kept boolean")
    return rows, table


def kmeans_sweep(
    df: DataFrame, features: Sequence[str] | str, ks: Sequence[int] = tuple(range(3, 16))
) -> tuple[DataFrame, dict]:
    """Silhouette (squared Euclidean) for each k: ``K, silhouette_score, is_best``, and the models."""
    data = _features(df, features).select("features").persist()
    score = ClusteringEvaluator(featuresCol="features")

    def fit(k: int):
        model = KMeans(k=k, seed=SEED, featuresCol="features").fit(data)
        several = sum(n > 0 for n in model.summary.clusterSizes) > 1
        return k, model, score.evaluate(model.transform(data)) if several else 0.0

    fitted = in_parallel(fit, list(ks), 8)
    models = {k: model for k, model, _ in fitted}
    rows = [(k, s) for k, _, s in fitted]
    data.unpersist()
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    table = df.sparkSession.createDataFrame(
        [(k, float(s), k == best) for k, s in rows], "K int, silhouette_score double, is_best boolean")
    return table, models


def kmeans_assign(df: DataFrame, features: Sequence[str] | str, model) -> DataFrame:
    return model.transform(_features(df, features)).withColumnRenamed("prediction", "cluster").drop("features")


def silhouette_rows(df: DataFrame, features: Sequence[str] | str, cluster: str = "cluster") -> DataFrame:
    """Silhouette of every row with squared Euclidean distance, from cluster sums.

    The mean distance of x to a cluster is |x|^2 - 2 x.m + q with the cluster mean m and mean
    squared norm q, so no pairs are needed; only k cluster rows reach the driver.
    """
    d = _features(df, features)
    norm = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x)
    stats = d.withColumn("__q", norm).groupBy(cluster).agg(
        Summarizer.mean(F.col("features")).alias("m"), F.avg("__q").alias("q"), F.count(F.lit(1)).alias("n"))
    rows = stats.orderBy(cluster).collect()  # one row per cluster
    ids = np.array([r[cluster] for r in rows])
    means = np.array([r["m"].toArray() for r in rows])
    q = np.array([r["q"] for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)

    @F.pandas_udf(DoubleType())
    def value(x: pd.Series, c: pd.Series) -> pd.Series:
        X = np.array(x.tolist())
        dist = (X**2).sum(axis=1)[:, None] - 2 * X @ means.T + q
        own = np.searchsorted(ids, c.to_numpy())
        at = np.arange(len(X))
        size = n[own]
        a = dist[at, own] * size / np.maximum(size - 1, 1)
        dist[at, own] = np.inf
        b = dist.min(axis=1)
        s = np.where((size > 1) & (len(ids) > 1), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        return pd.Series(s)

    return d.withColumn("silhouette", value(vector_to_array("features"), F.col(cluster))).drop("features")


def _prob(df: DataFrame, p: str = "probability", cls: int = 1) -> DataFrame:
    drop = [c for c in ("rawPrediction", p, "features", "scaled", "__w") if c in df.columns]
    return df.withColumn("prob", vector_to_array(p)[cls]).drop(*drop)


def _balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * n_class) per row."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    total = sum(counts.values())
    w = F.lit(1.0)
    for v, n in counts.items():
        w = F.when(F.col(label) == v, F.lit(total / (len(counts) * n))).otherwise(w)
    return df.withColumn("__w", w)


def _stored(model, spark):
    """A fitted classifier as saved and loaded. The training summary of one for two classes goes to the
    tasks with it and holds the session, which cannot be sent once a query of it has been observed."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    return type(model).load(path)


def _stored_last(model: PipelineModel, spark) -> PipelineModel:
    return PipelineModel(stages=[*model.stages[:-1], _stored(model.stages[-1], spark)])


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label") -> PipelineModel:
    """Scaled logistic regression."""
    return _stored_last(Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=100, regParam=1e-4),
    ]).fit(df), df.sparkSession)


def coefficients(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    w = model.stages[-1].coefficients.toArray()
    return spark.createDataFrame([(f, float(c)) for f, c in zip(features, w)], "feature string, coefficient double")


def _fit_trees(stage, df: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Fit on rows dealt over all cores: a join of small rows leaves a few partitions, by its bytes, while
    the work on a row grows with the trees."""
    if df.count() >= TREE_ROWS:
        df = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), stage]).fit(df)


def fit_tree(df: DataFrame, features: Sequence[str], label: str = "label", depth: int = 4) -> PipelineModel:
    return _fit_trees(DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=SEED), df, features)


def tree_rules(model: PipelineModel, features: Sequence[str]) -> str:
    """Readable rules with feature names."""
    text = model.stages[-1].toDebugString
    for i in range(len(features) - 1, -1, -1):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    return text


def fit_forest(
    df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 200, depth: int = 8
) -> PipelineModel:
    """Random forest with balanced class weights."""
    stage = RandomForestClassifier(
        labelCol=label, weightCol="__w", numTrees=trees, maxDepth=depth, seed=SEED)
    return _stored_last(_fit_trees(stage, _balanced(df, label), features), df.sparkSession)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 5) -> PipelineModel:
    """Boosted trees for two classes."""
    stage = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=SEED)
    return _fit_trees(stage, df, features)


def fit_gbt_multiclass(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 20, depth: int = 3) -> PipelineModel:
    """Boosted trees for several classes, one against the rest."""
    stage = OneVsRest(
        labelCol=label, classifier=GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=SEED))
    return _fit_trees(stage, df, features)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``prob`` of class 1 (binary models) and ``prediction``."""
    out = model.transform(df.withColumn("__w", F.lit(1.0)))
    if "probability" in out.columns:
        return _prob(out)
    return out.drop("rawPrediction", "features", "scaled", "__w")


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    v = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, v)], "feature string, importance double")


def fit_on_embeddings(
    df: DataFrame, embedding: str, label: str = "label", kind: str = "logistic", hidden: int = 64
) -> tuple[object, Callable[[DataFrame], DataFrame]]:
    """Classifier head on stored embeddings: logistic regression or one hidden layer."""
    data = _features(df, embedding)
    if kind == "logistic":
        model = LogisticRegression(labelCol=label, maxIter=100, regParam=1e-3).fit(data)
        model = _stored(model, df.sparkSession)
    else:
        size = len(data.select("features").first()[0])
        classes = int(data.agg(F.max(label)).first()[0]) + 1
        model = MultilayerPerceptronClassifier(
            labelCol=label, layers=[size, hidden, classes], maxIter=100, seed=SEED).fit(data)

    def score(rows: DataFrame) -> DataFrame:
        return _prob(model.transform(_features(rows, embedding)))

    return model, score


def _grow(values: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list:
    """Nested split [feature, cut, left, right] or leaf size."""
    n = len(values)
    spread = np.flatnonzero(values.max(axis=0) > values.min(axis=0)) if n > 1 else []
    if depth >= limit or len(spread) == 0:
        return [n]
    f = int(rng.choice(spread))
    cut = float(rng.uniform(values[:, f].min(), values[:, f].max()))
    low = values[:, f] < cut
    return [f, cut, _grow(values[low], rng, depth + 1, limit), _grow(values[~low], rng, depth + 1, limit)]


def _path_average(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _flat(tree: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and path length of every node of a nested tree, and its children: the high one at twice the node's
    number, the low one after it. A leaf is its own child."""
    nodes, feature, cut, child, length = [(tree, 0)], [], [], [], []
    for at, (node, depth) in enumerate(nodes):  # grows while it is read
        leaf = len(node) == 1
        feature.append(0 if leaf else node[0])
        cut.append(0.0 if leaf else node[1])
        child += [at, at] if leaf else [len(nodes) + 1, len(nodes)]
        length.append(depth + _path_average(node[0]) if leaf else 0.0)
        if not leaf:
            nodes += [(node[2], depth + 1), (node[3], depth + 1)]
    return np.array(feature, np.intp), np.array(cut), np.array(child, np.intp), np.array(length)


def _path_lengths(forest: list, X: np.ndarray, limit: int) -> np.ndarray:
    """Sum over the flat trees of the path length of each row of ``X``; rows go down a tree together, a level
    at a time."""
    total, flat = np.zeros(len(X)), np.ascontiguousarray(X).ravel()
    first = np.arange(len(X), dtype=np.intp) * X.shape[1]
    for feature, cut, child, length in forest:
        at = np.zeros(len(X), np.intp)
        for _ in range(limit):
            value = flat.take(feature.take(at) + first)
            below = value < cut.take(at)  # false for NaN
            at += at
            at += below
            at = child.take(at)
        total += length.take(at)
    return total


def isolation_forest(
    df: DataFrame, features: Sequence[str], contamination: float = 0.10, trees: int = 100,
    sample: int = 256, key: str = "id",
) -> DataFrame:
    """Isolation-forest score (higher = more anomalous) and flag of the top share.

    Each tree grows in its own task on about ``sample`` rows. One rule at every size: a row draws by
    hash how many trees it joins, as if each took it with probability sample / rows, and which; rows
    that join none (nearly all of a large table) are not listed. The trees (bounded by trees x sample
    nodes) are then shipped to score every row in place.
    """
    features = list(features)
    n = df.count()
    share = min(1.0, sample / max(n, 1))
    # Cumulative binomial probabilities of joining 0, 1, ... trees.
    upto, p = [], (1.0 - share) ** trees
    for i in range(trees):
        upto.append((upto[-1] if upto else 0.0) + p)
        p = p * (trees - i) / (i + 1) * (share / (1.0 - share) if share < 1 else 0.0)
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(SEED)), 11).cast("double") / float(1 << 53)
    # Nearly every row joins none; only the others look through the list.
    joins = F.when(u < upto[0], 0).otherwise(
        F.size(F.filter(F.array(*[F.lit(x) for x in upto]), lambda x: x <= u))) if share < 1 else F.lit(trees)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        F.xxhash64(F.col("__key"), t, F.lit(SEED + 1)).alias("h"), t.alias("t"))))
    cols = [F.col(f).cast("double").alias(f) for f in features]
    drawn = df.select(F.col(key).alias("__key"), joins.alias("__joins"), *cols).where("__joins > 0")
    drawn = drawn.withColumn("tree", F.explode(F.slice(order, F.lit(1), F.col("__joins"))))
    drawn = drawn.select(F.col("tree.t").alias("tree"), *features)
    limit = max(1, math.ceil(math.log2(max(2, min(sample, n)))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        values = pdf[features].sort_values(features).to_numpy()
        tree = _grow(values, np.random.default_rng(SEED + t), 0, limit)
        return pd.DataFrame({"tree": [t], "size": [len(values)], "nodes": [json.dumps(tree)]})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, size long, nodes string")
    rows = grown.orderBy("tree").collect()  # one bounded tree each
    forest = [_flat(json.loads(r["nodes"])) for r in rows]
    typical = _path_average(float(np.mean([r["size"] for r in rows])))

    @F.pandas_udf(DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        X = np.column_stack([s.to_numpy(dtype=float) for s in series])
        total = _path_lengths(forest, X, limit)
        return pd.Series(2.0 ** (-total / len(forest) / max(typical, 1e-9)))

    scored = materialize(df.withColumn("anomaly_score", score(*cols)))
    cut = exact_quantiles(scored, "anomaly_score", {"__cut": 1.0 - contamination})
    out = scored.join(F.broadcast(cut))  # one row
    return out.withColumn("is_anomaly", (F.col("anomaly_score") > F.col("__cut")).cast("int")).drop("__cut")


def explain_zscore(df: DataFrame, features: Sequence[str], flag: str | None = None) -> DataFrame:
    """Feature with the largest absolute z-score of each (flagged) row, as text."""
    stats = df.agg(*[F.avg(f).alias(f"__m_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    j = df.join(F.broadcast(stats))  # one row
    z = [F.abs(F.col(f) - F.col(f"__m_{f}")) / (F.col(f"__s_{f}") + F.lit(1e-9)) for f in features]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    name = F.coalesce(*[F.when(x == top, F.lit(f)) for x, f in zip(z, features)])
    text = F.concat(name, F.lit(" deviates "), F.format_number(top, 2), F.lit(" sd"))
    shown = F.lit(True) if flag is None else F.col(flag) == 1
    j = j.withColumn("top_feature", name).withColumn("top_z", top)
    j = j.withColumn("explanation", F.when(shown, text).otherwise(F.lit("")))
    return j.drop(*[f"__{p}_{f}" for p in "ms" for f in features])


Fit = Callable[[DataFrame, Sequence[str]], PipelineModel]


def impact(delta: Column) -> Column:
    # Class limits of an AUC change.
    return F.when(delta < -0.05, "CRITICAL").when(delta < -0.02, "significant").when(
        delta < 0, "moderate").otherwise("negligible")


def ablation(
    train: DataFrame, test: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]],
    fit: Fit, label: str = "label",
) -> DataFrame:
    """AUC and F1 without each feature group, and the change against the full model, with intervals
    after DeLong: both models score the same rows, so the change has less spread than either AUC."""
    train = train.persist()
    spark = train.sparkSession
    # Scored by the full model once; every other model adds its score to the same rows.
    test = materialize(predict(fit(train, list(features)), test).select(*test.columns, F.col("prob").alias("__full")))

    def without(item):
        name, dropped = item
        kept = [f for f in features if f not in dropped]
        scored = predict(fit(train, kept), test) if dropped else test.withColumn("prob", F.col("__full"))
        scored = materialize(scored.select(label, "prob", "__full"))
        m = binary_metrics(scored, label, "prob").first()
        own, change = auc_interval(scored, label, "prob").first(), auc_difference(scored, label, "__full", "prob").first()
        return (name, ",".join(dropped), len(dropped), float(m["auc"]), own["auc_lo"], own["auc_hi"], float(m["f1"]),
                change["delta_lo"], change["delta_hi"])

    rows = in_parallel(without, list({"full": [], **groups}.items()))
    train.unpersist()
    auc, f1 = rows[0][3], rows[0][6]
    out = spark.createDataFrame(
        [(*r, r[3] - auc, r[6] - f1) for r in rows],
        "group string, dropped_cols string, n_dropped int, auc_ablated double, auc_lo double, auc_hi double, "
        "f1_ablated double, delta_lo double, delta_hi double, delta_auc double, delta_f1 double")
    return out.withColumn("impact", impact(F.col("delta_auc")))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], label: str = "label", key: str = "id"
) -> DataFrame:
    """AUC lost when one column is permuted across rows.

    Rows are dealt into hash buckets of bounded size; in a bucket, each column takes the value of the
    row before in a hash order of its own, the first row that of the last. All columns are permuted
    in one shuffle, reproducibly.
    """
    buckets = max(1, math.ceil(df.count() / PERMUTED_ROWS))
    dealt = df.select(key, label, *features, F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(buckets)).alias("__b"))
    moved = []
    for i, f in enumerate(features):
        order = Window.partitionBy("__b").orderBy(F.xxhash64(F.col(key), F.lit(SEED + 1 + i)), key)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        moved.append(F.when(F.row_number().over(order) == 1, F.last(f).over(whole)).otherwise(
            F.lag(f).over(order)).alias(f"__p_{f}"))
    base = materialize(dealt.select(key, label, *features, *moved))
    full = binary_metrics(predict(model, base.select(key, label, *features)), label, "prob").first()["auc"]

    def without(f: str):
        mixed = base.select(key, label, *[F.col(f"__p_{f}").alias(f) if c == f else F.col(c) for c in features])
        auc = binary_metrics(predict(model, mixed), label, "prob").first()["auc"]
        return f, None if full is None or auc is None else float(full - auc)

    rows = in_parallel(without, features)
    return df.sparkSession.createDataFrame(rows, "feature string, auc_drop double")


def backtest(
    df: DataFrame, features: Sequence[str], label: str, fits: Mapping[str, Fit], min_train: int = 2,
    period: str = "period",
) -> tuple[DataFrame, DataFrame]:
    """Expanding-window forecasts of a class label on a period table: for each period the models
    are fitted on all earlier periods.

    Returns the hit table ``period, model, truth, forecast, hit, n_train`` and the hit rates.
    The loop runs over periods of a small aggregated table.
    """
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df)
    names = index.labels
    data = index.transform(df).persist()
    seen = data.select(period, "__y").distinct().collect()  # periods x classes
    periods = sorted({r[0] for r in seen})
    steps = []
    for i, t in enumerate(periods):
        classes = sorted({r[1] for r in seen if r[0] < t})
        if i >= min_train and len(classes) > 1:
            steps += [(i, t, classes, name, fit) for name, fit in fits.items()]
    if not steps:
        raise ValueError("no period has two classes before it")

    def forecast(step) -> DataFrame:
        i, t, classes, name, fit = step
        code, back = F.lit(None).cast("double"), F.lit(None).cast("string")
        for k, c in enumerate(classes):
            code = F.when(F.col("__y") == c, F.lit(float(k))).otherwise(code)
            back = F.when(F.col("prediction") == k, F.lit(names[int(c)])).otherwise(back)
        model = fit(data.where(F.col(period) < t).withColumn("__code", code), features)
        got = predict(model, data.where(F.col(period) == t))
        return got.select(
            period, F.lit(name).alias("model"), F.col(label).alias("truth"), back.alias("forecast"),
            F.lit(i).alias("n_train"))

    parts = in_parallel(forecast, steps)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = materialize(hits.withColumn("hit", (F.col("forecast") == F.col("truth")).cast("int")))
    data.unpersist()
    rates = hits.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_transitions"), F.sum("hit").alias("n_correct"), F.avg("hit").alias("hit_rate"))
    return hits, rates
