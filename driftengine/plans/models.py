"""Clustering, classifiers, evaluation, monitoring and streaming over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftengine.operators import evaluate, linear, lloyd, models, monitor, sampling, sequence, series, sparse, validate
from driftengine.plans.data import (
    DAYS,
    DOCS,
    MONTHS,
    PREDS,
    R,
    day_metrics,
    doc_records,
    month_series,
    order_records,
    predictions,
    rounded,
    table,
)
from driftengine.plans.registry import query
from driftengine.scale import materialize, shared_dir
from driftengine.streaming import monitor as streaming

FEATURES = ["price", "month", "priority", "n_lines", "quantity", "discount"]


def order_features(spark: SparkSession, d: str) -> DataFrame:
    """Orders with numeric features; label = the mean discount of the order is at least 5 %."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.avg("l_quantity").alias("quantity"),
        F.avg("l_tax").alias("discount"), F.avg("l_discount").alias("rebate"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    signal = F.col("rebate") + F.col("quantity") / 1000 - F.col("n_lines") / 200
    return o.select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("period"),
        (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").cast("double").alias("month"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), "n_lines", "quantity", "discount",
        (signal >= 0.055).cast("int").alias("label"))


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Earlier and later orders."""
    rows = materialize(order_features(spark, d))
    return rows.where("period < 1999"), rows.where("period >= 1999")


# --- clustering and features ---------------------------------------------------------------


@query("h1_pca_keep")
def h1(spark, d):
    return rounded(models.pca_keep(table(spark, d, "embeddings"), "embedding")[1])


@query("h1_pca_kmers")
def h1_kmers(spark, d):
    profile = sequence.kmer_profile(order_records(spark, d), 1)
    return rounded(sparse.sparse_pca(profile)[1])


def word_parts(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Shares of the 3-symbol strings of every document, and the number of documents."""
    docs = doc_records(spark, d)
    return sequence.kmer_profile(docs, 3), docs.count()


@query("h1_pca_documents")
def h1_documents(spark, d):
    profile, n = word_parts(spark, d)
    return rounded(sparse.sparse_pca(profile, 8, n_rows=n)[1], 4)


@query("h1_kmer_variance", f"""WITH {DOCS}, k AS (SELECT id, sequence[i:i + 2] AS kmer, count(*) AS n FROM (SELECT id, sequence, unnest(range(1, length(sequence) - 1)) AS i FROM docs) GROUP BY ALL),
  p AS (SELECT id, kmer, n / sum(n) OVER (PARTITION BY id) AS f FROM k), c AS (SELECT count(*) AS n FROM docs),
  v AS (SELECT kmer, (sum(f * f) - sum(f) ** 2 / any_value(n)) / (any_value(n) - 1) AS v FROM p, c GROUP BY 1)
  SELECT count(*) AS n_terms, {R('sum(v)', 'total_variance')} FROM v""")
def h1_variance(spark, d):
    profile, n = word_parts(spark, d)
    return rounded(sparse.total_variance(profile, n))


@query("h2_kmeans_sweep")
def h2(spark, d):
    return rounded(models.kmeans_sweep(table(spark, d, "embeddings"), "embedding")[0])


@query("h3_silhouette_rows", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) AS n FROM e a JOIN e b ON true GROUP BY ALL),
  m AS (SELECT vec_id, own, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY 1, 2)
  SELECT vec_id, own AS label, {R('(b - a) / greatest(a, b)', 'silhouette')} FROM m""")
def h3(spark, d):
    return rounded(models.silhouette_rows(table(spark, d, "embeddings"), "embedding", "label").select(
        "vec_id", "label", "silhouette"))


PURITY = """pu AS (SELECT source, CAST(sum(n) AS BIGINT) AS size, arg_min(lang, (-n, lang)) AS dominant, max(n) AS n_dominant FROM
  (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1)"""


@query("h4_purity", f"WITH {PURITY} SELECT source, size, dominant, n_dominant, {R('n_dominant / size', 'purity')} FROM pu")
def h4(spark, d):
    return rounded(evaluate.purity(table(spark, d, "documents"), "source", "lang"))


@query("h4_purity_overall", f"""WITH {PURITY} SELECT CAST(sum(size) AS BIGINT) AS n, {R('sum(n_dominant) / sum(size)', 'purity')},
  CASE WHEN sum(n_dominant) / sum(size) > 7e-1 THEN 'PASS' WHEN sum(n_dominant) / sum(size) >= 6e-1 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM pu""")
def h4_overall(spark, d):
    return rounded(evaluate.purity_overall(table(spark, d, "documents"), "source", "lang"))


@query("h2_lloyd_sweep")
def h2_lloyd(spark, d):
    return rounded(lloyd.lloyd_sweep(table(spark, d, "embeddings"), "embedding", key="vec_id")[0])


LLOYD_KS, LLOYD_ROUNDS = (3, 5), 2


def _lloyd_sql(k: int) -> str:
    """Rounds of k-means from the first ``k`` rows in hash order: assignments a, centres c, and the inertia."""
    ctes = [f"k{k}c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(id || ':42'), id) AS c, x FROM e QUALIFY c <= {k})"]
    for i in range(LLOYD_ROUNDS + 1):
        ctes.append(f"""k{k}a{i} AS MATERIALIZED (SELECT id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT e.id, e.x, k.c, list_distance(e.x, k.x) ** 2 AS d FROM e, k{k}c{i} k) GROUP BY id, x)""")
        if i < LLOYD_ROUNDS:
            ctes.append(f"""k{k}c{i + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS x FROM (SELECT c, j, avg(v) AS m FROM (
      SELECT c, unnest(x) AS v, unnest(range(len(x))) AS j FROM k{k}a{i}) GROUP BY c, j) GROUP BY c)""")
    return ",\n  ".join(ctes)


@query("h2_lloyd_inertia", f"""WITH e AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
  {', '.join(_lloyd_sql(k) for k in LLOYD_KS)}
  {' UNION ALL '.join(f"SELECT {k} AS K, {R('sum(d)', 'inertia')} FROM k{k}a{LLOYD_ROUNDS}" for k in LLOYD_KS)}""")
def h2_inertia(spark, d):
    found = lloyd.lloyd_sweep(table(spark, d, "embeddings"), "embedding", LLOYD_KS, "vec_id", LLOYD_ROUNDS)[0]
    return rounded(found.select("K", "inertia"))


@query("h2_kmeans_purity")
def h2_purity(spark, d):
    rows = table(spark, d, "embeddings")
    _, found = models.kmeans_sweep(rows, "embedding", [10])
    return rounded(evaluate.purity_overall(models.kmeans_assign(rows, "embedding", found[10]), "cluster", "label"))


# --- classifiers ---------------------------------------------------------------------------


def _scored(spark, d, fit):
    train, test = halves(spark, d)
    model = fit(train)
    return rounded(evaluate.binary_metrics(models.predict(model, test), "label", "prob"))


@query("h5_logistic")
def h5(spark, d):
    return _scored(spark, d, lambda t: models.fit_logistic(t, FEATURES))


@query("h5_coefficients")
def h5_coef(spark, d):
    model = models.fit_logistic(order_features(spark, d), FEATURES)
    return rounded(models.coefficients(model, FEATURES, spark))


CV_FEATURES = ["price", "month", "status"]
CV_ROWS = """cv AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label, CAST(year(o_orderdate) AS INTEGER) AS period,
  o_totalprice / 1e5 AS price, month(o_orderdate) + 0e0 AS month, CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 2e0 ELSE 4e0 END AS status FROM orders)"""


def cv_rows(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 2.0).otherwise(4.0)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"),
        F.year("o_orderdate").alias("period"), (F.col("o_totalprice") / 1e5).alias("price"),
        F.month("o_orderdate").cast("double").alias("month"), status.alias("status"))


NEWTON_FEATURES, NEWTON_STEPS, NEWTON_L2 = ["price", "month"], 8, 0.01


def _newton_sql() -> str:
    """Newton steps of a logistic regression on two standardised features, unrolled; systems of three
    by Cramer's rule."""
    ctes = ["b0 AS (SELECT 0e0 AS w0, 0e0 AS w1, 0e0 AS w2)"]
    for i in range(NEWTON_STEPS):
        ctes.append(f"""h{i} AS (SELECT any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, avg(q) AS a, avg(q * x1) AS b, avg(q * x2) AS c,
      avg(q * x1 * x1) + {NEWTON_L2} AS d, avg(q * x1 * x2) AS e, avg(q * x2 * x2) + {NEWTON_L2} AS f, avg(p - y) AS g0,
      avg((p - y) * x1) + {NEWTON_L2} * any_value(w1) AS g1, avg((p - y) * x2) + {NEWTON_L2} * any_value(w2) AS g2
      FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) AS p FROM st, b{i})))""")
        ctes.append(f"""b{i + 1} AS (SELECT w0 - (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS w0,
      w1 - (a * (g1 * f - e * g2) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS w1,
      w2 - (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS w2
      FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM h{i}))""")
    return ",\n  ".join(ctes)


@query("h5_newton_coefficients", f"""WITH {CV_ROWS}, mo AS (SELECT avg(price) AS m1, stddev_pop(price) AS s1, avg(month) AS m2, stddev_pop(month) AS s2 FROM cv),
  st AS (SELECT CASE WHEN status = 1 THEN 1e0 ELSE 0e0 END AS y, (price - m1) / s1 AS x1, (month - m2) / s2 AS x2 FROM cv, mo),
  {_newton_sql()}, o AS (SELECT w0 - w1 * m1 / s1 - w2 * m2 / s2 AS i, w1 / s1 AS c1, w2 / s2 AS c2 FROM b{NEWTON_STEPS}, mo)
  SELECT '(intercept)' AS feature, {R('i', 'coefficient')} FROM o UNION ALL SELECT 'price', {R('c1')} FROM o UNION ALL SELECT 'month', {R('c2')} FROM o""")
def h5_newton(spark, d):
    rows = cv_rows(spark, d).withColumn("y", (F.col("status") == 1).cast("int"))
    return rounded(linear.fit_newton(rows, NEWTON_FEATURES, "y", NEWTON_L2).table(spark))


@query("h9_embeddings_newton")
def h9_newton(spark, d):
    rows = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    head = linear.fit_newton(rows, "embedding", "y")
    return rounded(evaluate.binary_metrics(head(rows), "y", "prob"))


@query("h6_decision_tree")
def h6(spark, d):
    return _scored(spark, d, lambda t: models.fit_tree(t, FEATURES))


@query("h6_tree_rules")
def h6_rules(spark, d):
    model = models.fit_tree(order_features(spark, d), FEATURES, depth=3)
    rows = [(i, line) for i, line in enumerate(models.tree_rules(model, FEATURES).splitlines())]
    return spark.createDataFrame(rows, "line int, rule string")


@query("h7_random_forest")
def h7(spark, d):
    return _scored(spark, d, lambda t: models.fit_forest(t, FEATURES))


@query("h7_importances")
def h7_importances(spark, d):
    model = models.fit_forest(materialize(order_features(spark, d)), FEATURES)
    return rounded(models.importances(model, FEATURES, spark))


@query("h8_boosted_trees")
def h8(spark, d):
    return _scored(spark, d, lambda t: models.fit_gbt(t, FEATURES))


@query("h8_boosted_multiclass")
def h8_multi(spark, d):
    rows = materialize(order_features(spark, d).withColumn("era", F.least(F.greatest(F.col("period") - 1996, F.lit(0)), F.lit(2))))
    model = models.fit_gbt_multiclass(rows, FEATURES, "era")
    got = models.predict(model, rows)
    return got.groupBy("era", F.col("prediction").cast("int").alias("found")).agg(F.count(F.lit(1)).alias("n"))


def _embeddings(spark, d, kind):
    rows = table(spark, d, "embeddings").withColumn("label", (F.col("label") >= 5).cast("int"))
    parts = materialize(sampling.split(rows, "label", (0.8, 0.2), "vec_id", names=("train", "test")))
    _, score = models.fit_on_embeddings(parts.where("part = 'train'"), "embedding", kind=kind)
    return rounded(evaluate.binary_metrics(score(parts.where("part = 'test'")), "label", "prob"))


@query("h9_embeddings_logistic")
def h9(spark, d):
    return _embeddings(spark, d, "logistic")


@query("h9_embeddings_mlp")
def h9_mlp(spark, d):
    return _embeddings(spark, d, "mlp")


@query("h10_isolation_forest")
def h10(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scored = models.isolation_forest(rows, cols)
    return rounded(models.explain_zscore(scored, cols, "is_anomaly").groupBy("is_anomaly", "top_feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("mean_score")))


@query("h10_explain_zscore", f"""WITH {DAYS}, s AS (SELECT avg(m1) AS a1, avg(m2) AS a2, avg(m3) AS a3, stddev_pop(m1) + 1e-9 AS s1, stddev_pop(m2) + 1e-9 AS s2, stddev_pop(m3) + 1e-9 AS s3 FROM days),
  z AS (SELECT entity, version, abs(m1 - a1) / s1 AS z1, abs(m2 - a2) / s2 AS z2, abs(m3 - a3) / s3 AS z3 FROM days, s)
  SELECT entity, version, CASE WHEN z1 >= z2 AND z1 >= z3 THEN 'm1' WHEN z2 >= z3 THEN 'm2' ELSE 'm3' END AS top_feature, {R('greatest(z1, z2, z3)', 'top_z')} FROM z""")
def h10_explain(spark, d):
    return rounded(models.explain_zscore(day_metrics(spark, d), ["m1", "m2", "m3"]).select(
        "entity", "version", "top_feature", "top_z"))


# --- evaluation ----------------------------------------------------------------------------

METRICS_SQL = """c AS (SELECT {by} count(*) FILTER (WHERE prob >= 5e-1 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 5e-1 AND label = 0) AS fp,
    count(*) FILTER (WHERE prob < 5e-1 AND label = 1) AS fn, count(*) FILTER (WHERE prob < 5e-1 AND label = 0) AS tn FROM preds {group}),
  rk AS (SELECT {by} label, rank() OVER ({part} ORDER BY prob) + (count(*) OVER (PARTITION BY {by} prob) - 1) / 2e0 AS r FROM preds),
  au AS (SELECT {by} (sum(r) FILTER (WHERE label = 1) - CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
    / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)) AS auc FROM rk {group}),
  met AS (SELECT c.*, auc, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
    (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c {join})"""
ALL_METRICS = METRICS_SQL.format(by="", group="", part="", join=", au")
GRP_METRICS = METRICS_SQL.format(by="grp,", group="GROUP BY grp", part="PARTITION BY grp", join="JOIN au USING (grp)")
MET = ", ".join(R(m) for m in ("auc", "accuracy", "precision", "recall", "f1", "mcc"))


@query("h11_binary_metrics", f"WITH {PREDS}, {ALL_METRICS} SELECT tp, fp, fn, tn, {MET} FROM met")
def h11(spark, d):
    return rounded(evaluate.binary_metrics(predictions(spark, d), "label", "prob"))


@query("h11_binary_metrics_by_group", f"WITH {PREDS}, {GRP_METRICS} SELECT grp, tp, fp, fn, tn, {MET} FROM met")
def h11_group(spark, d):
    return rounded(evaluate.binary_metrics(predictions(spark, d), "label", "prob", by=["grp"]))


SCORED = """sc AS (SELECT l_discount AS prob, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
  g AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM sc GROUP BY 1),
  ro AS (SELECT prob AS threshold, CAST(sum(p) OVER (ORDER BY prob DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY prob DESC) AS BIGINT) AS fp,
    CAST(sum(p) OVER () AS BIGINT) AS tot_p, CAST(sum(n) OVER () AS BIGINT) AS tot_n FROM g)"""


def discount_scores(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_discount").alias("prob"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


@query("h12_roc_points", f"WITH {SCORED} SELECT {R('threshold')}, tp, fp, {R('tp / tot_p', 'tpr')}, {R('fp / tot_n', 'fpr')}, tot_p - tp AS fn FROM ro")
def h12(spark, d):
    return rounded(evaluate.roc_points(discount_scores(spark, d), "label", "prob"))


@query("h13_best_threshold", f"""WITH {PREDS}, g AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM preds GROUP BY 1),
  ro AS (SELECT prob AS t, sum(p) OVER (ORDER BY prob DESC) AS tp, sum(n) OVER (ORDER BY prob DESC) AS fp, sum(p) OVER () AS tot FROM g),
  f AS (SELECT t, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + tot - tp) ELSE 0e0 END AS f1 FROM ro),
  b AS (SELECT t, f1 FROM f ORDER BY f1 DESC, t LIMIT 1)
  SELECT {R('t', 'raw_threshold')}, {R('least(greatest(t, 35e-2), 65e-2)', 'threshold')}, {R('f1')} FROM b""")
def h13(spark, d):
    return rounded(evaluate.best_threshold(predictions(spark, d), "label", "prob"))


@query("h14_ablation")
def h14(spark, d):
    train, test = halves(spark, d)
    groups = {"lines": ["n_lines", "quantity"], "time": ["month"], "money": ["price", "discount"]}
    return rounded(models.ablation(train, test, FEATURES, groups, lambda t, f: models.fit_logistic(t, f)))


@query("h15_permutation_importance")
def h15(spark, d):
    train, test = halves(spark, d)
    return rounded(models.permutation_importance(models.fit_logistic(train, FEATURES), test, FEATURES))


@query("h16_fold_summary", f"""WITH {PREDS}, {GRP_METRICS} SELECT 'price' AS model, count(*) AS n_folds, {R('avg(auc)', 'auc_mean')}, {R('stddev_samp(auc)', 'auc_std')},
  {R('avg(f1)', 'f1_mean')}, {R('stddev_samp(f1)', 'f1_std')} FROM met""")
def h16(spark, d):
    m = evaluate.binary_metrics(predictions(spark, d), "label", "prob", by=["grp"]).withColumn("model", F.lit("price"))
    return rounded(evaluate.fold_summary(m, "model", ["auc", "f1"]))


@query("h17_compare_models", f"""WITH {PREDS}, {GRP_METRICS}, b AS (SELECT max(auc) AS best FROM met WHERE grp <> '1-URGENT')
  SELECT grp, {R('auc')}, {R('best', 'best_baseline')}, {R('auc - best', 'delta')}, grp = '1-URGENT' AS is_subject FROM met, b""")
def h17(spark, d):
    m = evaluate.binary_metrics(predictions(spark, d), "label", "prob", by=["grp"]).select("grp", "auc")
    return rounded(evaluate.compare_models(m, "grp", "auc", "1-URGENT"))


@query("h18_degradation", f"""WITH {PREDS}, {GRP_METRICS} SELECT m.grp, {R('m.auc', 'auc')}, {R('m.f1', 'f1')}, {R('m.auc - r.auc', 'delta_auc')}, {R('m.f1 - r.f1', 'delta_f1')}
  FROM met m, met r WHERE r.grp = '5-LOW'""")
def h18(spark, d):
    m = evaluate.binary_metrics(predictions(spark, d), "label", "prob", by=["grp"]).select("grp", "auc", "f1")
    return rounded(evaluate.degradation(m, "grp", "5-LOW", ["auc", "f1"]))


Z95 = 1.959963984540054e0
#: Placement values per counted score of ``src`` (groups, score, label), and the closed-form interval.
DELONG = """cells AS (SELECT {by} prob AS score, count(*) FILTER (WHERE label = 1) AS wp, count(*) FILTER (WHERE label <> 1) AS wn FROM {src} GROUP BY ALL),
  pl AS (SELECT *, sum(wp) OVER (PARTITION BY {part}) AS p, sum(wn) OVER (PARTITION BY {part}) AS n,
    (sum(wn) OVER (PARTITION BY {part} ORDER BY score) - wn / 2) / sum(wn) OVER (PARTITION BY {part}) AS v10,
    (sum(wp) OVER (PARTITION BY {part}) - sum(wp) OVER (PARTITION BY {part} ORDER BY score) + wp / 2) / sum(wp) OVER (PARTITION BY {part}) AS v01 FROM cells),
  mu AS (SELECT {by} sum(wp * v10) / any_value(p) AS a FROM pl GROUP BY ALL),
  va AS (SELECT {by} CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg, any_value(a) AS auc,
    sqrt(sum(wp * (v10 - a) ** 2) / (any_value(p) - 1) / any_value(p) + sum(wn * (v01 - a) ** 2) / (any_value(n) - 1) / any_value(n)) AS se
    FROM pl JOIN mu {join} GROUP BY ALL)"""
GRP_DELONG = DELONG.format(by="grp,", src="preds", part="grp", join="USING (grp)")


@query("h18_auc_intervals", f"""WITH {PREDS}, {GRP_DELONG}, r AS (SELECT auc AS ra, se AS rs FROM va WHERE grp = '5-LOW')
  SELECT grp, n_pos, n_neg, {R('auc')}, {R('se', 'auc_se')}, {R(f'greatest(auc - {Z95} * se, 0)', 'auc_lo')}, {R(f'least(auc + {Z95} * se, 1)', 'auc_hi')},
    {R('auc - ra', 'delta_auc')}, CASE WHEN grp <> '5-LOW' THEN round(auc - ra - {Z95} * sqrt(se ** 2 + rs ** 2), 6) + 0e0 END AS delta_lo,
    CASE WHEN grp <> '5-LOW' THEN round(auc - ra + {Z95} * sqrt(se ** 2 + rs ** 2), 6) + 0e0 END AS delta_hi FROM va, r""")
def h18_intervals(spark, d):
    return rounded(evaluate.auc_degradation(predictions(spark, d), "label", "prob", "grp", "5-LOW"))


def _placed(col: str) -> str:
    """Placement values of the scores in ``col`` of ``two``."""
    return f"""{col}_c AS (SELECT {col}, count(*) FILTER (WHERE label = 1) AS wp, count(*) FILTER (WHERE label <> 1) AS wn FROM two GROUP BY 1),
  {col}_v AS (SELECT {col}, (sum(wn) OVER (ORDER BY {col}) - wn / 2) / sum(wn) OVER () AS {col}10,
    (sum(wp) OVER () - sum(wp) OVER (ORDER BY {col}) + wp / 2) / sum(wp) OVER () AS {col}01 FROM {col}_c)"""


@query("h14_auc_difference", f"""WITH two AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount AS x, l_quantity / 50 AS y FROM lineitem),
  {_placed('x')}, {_placed('y')}, j AS (SELECT * FROM two JOIN x_v USING (x) JOIN y_v USING (y)),
  m AS (SELECT avg(x10) FILTER (WHERE label = 1) AS a, avg(y10) FILTER (WHERE label = 1) AS b, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM j),
  s AS (SELECT any_value(a) AS a, any_value(b) AS b, sqrt(sum(CASE WHEN label = 1 THEN ((x10 - a) - (y10 - b)) ** 2 ELSE 0 END) / (any_value(p) - 1) / any_value(p)
    + sum(CASE WHEN label = 0 THEN ((x01 - a) - (y01 - b)) ** 2 ELSE 0 END) / (any_value(n) - 1) / any_value(n)) AS se FROM j, m)
  SELECT {R('a', 'auc_a')}, {R('b', 'auc_b')}, {R('b - a', 'delta')}, {R('se', 'delta_se')}, {R(f'b - a - {Z95} * se', 'delta_lo')}, {R(f'b - a + {Z95} * se', 'delta_hi')} FROM s""")
def h14_difference(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                              F.col("l_discount").alias("x"), (F.col("l_quantity") / 50).alias("y"))
    return rounded(evaluate.auc_difference(rows, "label", "x", "y").drop("p"))


# --- cross-validation ----------------------------------------------------------------------


def _gaussian_sql(train: str, test: str) -> str:
    """Scores of ``test`` (fold, id, label, features) by the normal distributions of ``train``, and by price alone."""
    stats = ", ".join(f"avg({f}) AS {f}_m, greatest(var_pop({f}), 1e-9) AS {f}_v" for f in CV_FEATURES)
    side = lambda a: " ".join(f"- 5e-1 * ln({a}.{f}_v) - (t.{f} - {a}.{f}_m) ** 2 / (2 * {a}.{f}_v)" for f in CV_FEATURES)
    return f"""gs AS (SELECT fold, label, count(*) AS n, {stats} FROM {train} GROUP BY ALL),
  scored AS (SELECT t.fold, 'gaussian' AS model, t.id, t.label, 1 / (1 + exp(-(ln(y.n / o.n) {side('y')} - (0 {side('o')})))) AS prob
    FROM {test} t JOIN gs y ON y.fold = t.fold AND y.label = 1 JOIN gs o ON o.fold = t.fold AND o.label = 0
    UNION ALL SELECT fold, 'price', id, label, price / 6 FROM {test})"""


FOLD_SCORES = DELONG.format(by="fold, model,", src="scored", part="fold, model", join="USING (fold, model)") + f""",
  th AS (SELECT fold, model, count(*) FILTER (WHERE prob >= 5e-1 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 5e-1 AND label = 0) AS fp,
    count(*) FILTER (WHERE prob < 5e-1 AND label = 1) AS fn, count(*) FILTER (WHERE prob < 5e-1 AND label = 0) AS tn FROM scored GROUP BY ALL),
  fm AS (SELECT fold, model, n_pos, n_neg, auc, greatest(auc - {Z95} * se, 0) AS auc_lo, least(auc + {Z95} * se, 1) AS auc_hi,
    CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM va JOIN th USING (fold, model))"""
KFOLDS = f"""WITH {CV_ROWS}, k AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42'), id) - 1) % 5 AS INTEGER) AS own FROM cv),
  tr AS (SELECT k.*, fold FROM k, range(5) f(fold) WHERE own <> fold), te AS (SELECT *, own AS fold FROM k), {_gaussian_sql('tr', 'te')}, {FOLD_SCORES}"""
SHOWN = f"model, n_pos, n_neg, {R('auc')}, {R('auc_lo')}, {R('auc_hi')}, {R('f1')}, {R('accuracy')}"
MEANS = ", ".join(f"{R(f'avg({m})', f'{m}_mean')}, {R(f'stddev_samp({m})', f'{m}_std')}" for m in ("auc", "f1", "accuracy"))
CV_COLUMNS = ["fold", "model", "n_pos", "n_neg", "auc", "auc_lo", "auc_hi", "f1", "accuracy"]


def _fitted():
    return {"gaussian": lambda t, f: validate.fit_gaussian(t, f), "price": F.col("price") / 6}


def kfold_metrics(spark: SparkSession, d: str) -> DataFrame:
    folds = sampling.kfold(cv_rows(spark, d), 5, "label")
    return validate.fold_metrics(validate.cross_predict(folds, CV_FEATURES, _fitted()))


@query("e9_cv_auc", f"{KFOLDS} SELECT CAST(fold AS INTEGER) AS fold, {SHOWN} FROM fm")
def e9_cv(spark, d):
    return rounded(kfold_metrics(spark, d).select(*CV_COLUMNS))


@query("h16_cv_summary", f"{KFOLDS} SELECT model, count(*) AS n_folds, {MEANS} FROM fm GROUP BY 1")
def h16_cv(spark, d):
    return rounded(validate.cv_summary(kfold_metrics(spark, d)))


@query("e6_cv_pipeline", f"""WITH {CV_ROWS}, f(fold, train_max, test_min, test_max) AS (VALUES ('one', 1997, 1997, 1998), ('two', 1998, 1998, 2000), ('three', 2000, 2000, 2002), ('none', 1990, 1990, 1995)),
  al AS (SELECT cv.*, fold FROM cv JOIN f ON period < train_max), ra AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY md5(id || ':42'), id) AS rk FROM al),
  le AS (SELECT fold, min(n) AS least FROM (SELECT fold, label, count(*) AS n FROM al GROUP BY ALL) GROUP BY 1),
  tr AS (SELECT ra.* FROM ra JOIN le USING (fold) WHERE rk <= least), te AS (SELECT cv.*, fold FROM cv JOIN f ON period >= test_min AND period < test_max),
  {_gaussian_sql('tr', 'te')}, {FOLD_SCORES}, ok AS (SELECT fm.* FROM fm WHERE n_pos + n_neg >= 20)
  SELECT fold, {SHOWN} FROM ok""")
def e6_cv(spark, d):
    folds = spark.createDataFrame(
        [("one", 1997, 1997, 1998), ("two", 1998, 1998, 2000), ("three", 2000, 2000, 2002), ("none", 1990, 1990, 1995)],
        "fold string, train_max int, test_min int, test_max int")
    tagged = sampling.temporal_folds(cv_rows(spark, d), folds)
    scored = validate.cross_predict(tagged, CV_FEATURES, _fitted(), balanced=True)
    return rounded(validate.fold_metrics(scored).select(*CV_COLUMNS))


ENS = """en AS (SELECT o_orderkey AS id, o_totalprice / 499999e0 AS p1, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 8e-1 ELSE 3e-1 END AS p2,
    month(o_orderdate) / 13 AS p3, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) / 7 AS p4 FROM orders),
  fi AS (SELECT id, p1, coalesce(p2, (p1 + p3 + p4) / 3) AS p2, p3, p4 FROM en),
  es AS (SELECT id, (p1 + p2 + p3 + p4) / 4 AS e, CAST((p1 > 5e-1)::INT + (p2 > 5e-1)::INT + (p3 > 5e-1)::INT + (p4 > 5e-1)::INT AS INTEGER) AS v FROM fi),
  eb AS (SELECT *, CASE v WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, v IN (0, 4) AS agree FROM es)"""


def ensemble_rows(spark, d):
    second = F.when(F.col("o_orderstatus") == "F", F.lit(0.8)).when(F.col("o_orderstatus") == "O", F.lit(0.3))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 499999.0).alias("p1"), second.alias("p2"),
        (F.month("o_orderdate") / 13).alias("p3"), (F.substring("o_orderpriority", 1, 1).cast("int") / 7).alias("p4"))
    return evaluate.ensemble(rows, ["p1", "p2", "p3", "p4"])


@query("h19_ensemble", f"WITH {ENS} SELECT id, {R('e', 'ensemble_prob')}, v AS models_predict_drift, confidence, agree FROM eb")
def h19(spark, d):
    return rounded(ensemble_rows(spark, d).select("id", "ensemble_prob", "models_predict_drift", "confidence", "agree"))


@query("h19_ensemble_summary", f"""WITH {ENS} SELECT count(*) AS n, {R('avg(agree::INT) * 100', 'agreement_pct')}, {R('avg(e)', 'mean_prob')},
  count(*) FILTER (WHERE confidence = 'HIGH') AS n_high, count(*) FILTER (WHERE confidence = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE confidence = 'LOW') AS n_low,
  count(*) FILTER (WHERE confidence = 'NORMAL') AS n_normal, CASE WHEN avg(agree::INT) * 100 > 70 THEN 'PASS' ELSE 'FAIL' END AS status FROM eb""")
def h19_summary(spark, d):
    return rounded(evaluate.ensemble_summary(ensemble_rows(spark, d)))


YEARS = f"""{MONTHS}, yr AS (SELECT CAST(floor(period / 12) AS INTEGER) AS period, grp, avg(mean_price) / 1e4 AS price, avg(n) AS n, CASE WHEN avg(finished) > 3335e-4 THEN 'high' ELSE 'low' END AS label
    FROM months GROUP BY 1, 2)"""
G10 = f"""WITH {YEARS}, ce AS (SELECT avg(price) AS cp, avg(n) AS cn FROM yr), x AS (SELECT yr.*, price - cp AS x0, n - cn AS x1 FROM yr, ce),
  dr AS (SELECT period, dense_rank() OVER (ORDER BY period) - 1 AS n_train FROM (SELECT DISTINCT period FROM yr)),
  st AS (SELECT t.period AS t, n_train, x.label AS c, count(*) AS k, avg(x0) AS m0, avg(x1) AS m1, sum(x0 * x0) - sum(x0) ** 2 / count(*) AS w0, sum(x1 * x1) - sum(x1) ** 2 / count(*) AS w1
    FROM dr t JOIN x ON x.period < t.period GROUP BY ALL),
  md AS (SELECT *, sum(k) OVER (PARTITION BY t) AS tot, count(*) OVER (PARTITION BY t) AS nc, sum(w0) OVER (PARTITION BY t) AS v0, sum(w1) OVER (PARTITION BY t) AS v1 FROM st),
  sc AS (SELECT x.period, x.grp, x.label, n_train, c, ln(k / tot) - (x0 - m0) ** 2 / (2 * greatest(v0 / greatest(tot - nc, 1), 1e-9)) - (x1 - m1) ** 2 / (2 * greatest(v1 / greatest(tot - nc, 1), 1e-9)) AS s
    FROM x JOIN md ON md.t = x.period WHERE n_train >= 2 AND nc > 1),
  hi AS (SELECT period, grp, label AS truth, CAST(n_train AS INTEGER) AS n_train, c AS forecast, CAST(c = label AS INTEGER) AS hit
    FROM (SELECT *, row_number() OVER (PARTITION BY period, grp ORDER BY s DESC, c) AS rk FROM sc) WHERE rk = 1)"""


def year_hits(spark: SparkSession, d: str) -> DataFrame:
    m = month_series(spark, d).groupBy(F.floor(F.col("period") / 12).cast("int").alias("period"), "grp").agg(
        (F.avg("mean_price") / 1e4).alias("price"), F.avg("n").alias("n"), F.avg("finished").alias("f"))
    m = materialize(m.withColumn("label", F.when(F.col("f") > 0.3335, "high").otherwise("low")))
    return validate.prefix_backtest(m, ["price", "n"], "label")


@query("g10_hits", f"{G10} SELECT * FROM hi")
def g10_hits(spark, d):
    return year_hits(spark, d).select("period", "grp", F.col("label").alias("truth"), "n_train", "forecast", "hit")


@query("g10_hit_rate", f"{G10} SELECT count(*) AS n_transitions, CAST(sum(hit) AS BIGINT) AS n_correct, {R('avg(hit)', 'hit_rate')} FROM hi")
def g10_rate(spark, d):
    return rounded(validate.hit_rates(year_hits(spark, d)))


@query("g10_backtest")
def g10(spark, d):
    m = month_series(spark, d)
    m = m.groupBy(F.floor(F.col("period") / 12).cast("int").alias("period"), "grp").agg(
        F.avg("mean_price").alias("price"), F.avg("n").alias("n"), F.avg("finished").alias("f"))
    m = materialize(m.withColumn("label", F.when(F.col("f") > 0.3335, "high").otherwise("low")))
    fits = {"logistic": lambda t, f: models.fit_logistic(t, f, "__code"),
            "tree": lambda t, f: models.fit_tree(t, f, "__code", 2)}
    return rounded(models.backtest(m, ["price", "n"], "label", fits)[1])


# --- monitoring and streaming --------------------------------------------------------------


@query("s1_alert_levels", f"""WITH {PREDS} SELECT id, CASE WHEN prob >= 7e-1 THEN 'CRITICAL' WHEN prob >= 5e-1 THEN 'WARNING' WHEN prob >= 3e-1 THEN 'CAUTION' ELSE 'NORMAL' END AS alert_level,
  CASE WHEN prob >= 7e-1 THEN 'page' WHEN prob >= 5e-1 THEN 'mail' WHEN prob >= 3e-1 THEN 'log' END AS action FROM preds""")
def s1(spark, d):
    actions = {"CRITICAL": "page", "WARNING": "mail", "CAUTION": "log"}
    return monitor.alert_levels(predictions(spark, d), "prob", actions=actions).select("id", "alert_level", "action")


@query("s1_alerts", f"WITH {PREDS} SELECT id, CASE WHEN prob >= 7e-1 THEN 'CRITICAL' WHEN prob >= 5e-1 THEN 'WARNING' ELSE 'CAUTION' END AS alert_level FROM preds WHERE prob >= 3e-1")
def s1_alerts(spark, d):
    return monitor.alerts(predictions(spark, d), "prob").select("id", "alert_level")


@query("s2_status_record", f"""WITH {DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY version DESC) AS rk FROM days),
  l AS (SELECT entity, coalesce(string_agg(version, ',' ORDER BY version), '') AS at_risk FROM (SELECT entity, CASE WHEN n > 66 THEN version END AS version FROM r WHERE rk <= 3) GROUP BY 1)
  SELECT entity, version AS latest, {R('m1', 'drift_score')}, m2 > 35e-2 AS many_large, m3 > 5e-1 AS spread_high, at_risk,
    CASE WHEN m1 >= 7e-1 THEN 'CRITICAL' WHEN m1 >= 5e-1 THEN 'WARNING' WHEN m1 >= 3e-1 THEN 'CAUTION' ELSE 'NORMAL' END AS status FROM r JOIN l USING (entity) WHERE rk = 1""")
def s2(spark, d):
    flags = {"many_large": F.col("m2") > 0.35, "spread_high": F.col("m3") > 0.5}
    out = monitor.status_record(day_metrics(spark, d), "version", "m1", flags, F.col("n") > 66, ["entity"])
    out = out.withColumn("at_risk", F.concat_ws(",", F.col("at_risk").cast("array<string>")))
    return rounded(out.drop("record"))


@query("s2_status_json")
def s2_json(spark, d):
    flags = {"many_large": F.col("m2") > 0.35}
    days = day_metrics(spark, d)
    fc = series.ar1_forecast(days, "m1", 1, "version", ["entity"]).select("entity", F.round("forecast", 4).alias("next_forecast"))
    return monitor.status_record(days, "version", "m1", flags, F.col("n") > 66, ["entity"], forecast=fc).select("entity", "record")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of ``entity, ts, metric, kind``."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return as_events(raw)


def as_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("user_id").cast("string").alias("entity"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("metric"), F.col("event_type").alias("kind"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available into files and read them back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


WINDOWS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS entity, ts, value, CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END AS bad FROM events),
  w AS (SELECT entity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, count(*) AS n, avg(value) AS mm, avg(bad) AS es FROM ev GROUP BY 1, 2),
  cl AS (SELECT * FROM w WHERE DATE '2024-01-01' + day + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev))"""


def _days(df: DataFrame) -> DataFrame:
    day = F.datediff(F.to_date("window_start"), F.lit("2024-01-01").cast("date"))
    return df.withColumn("day", day)


@query("s3_stream_monitor", f"""WITH {WINDOWS}, b AS (SELECT entity, avg(value) AS bm, greatest(stddev_pop(value), 1e-9) AS bs, avg(bad) AS be FROM ev GROUP BY 1),
  x AS (SELECT entity, day, n, mm, es, sqrt(((mm - bm) / bs) ** 2 + (es - be) ** 2) AS distance FROM cl JOIN b USING (entity))
  SELECT entity, day, n, {R('mm', 'mean_metric')}, {R('es', 'error_share')}, {R('distance')}, CASE WHEN distance / (1 + distance) >= 7e-1 THEN 'CRITICAL'
    WHEN distance / (1 + distance) >= 5e-1 THEN 'WARNING' WHEN distance / (1 + distance) >= 3e-1 THEN 'CAUTION' ELSE 'NORMAL' END AS alert_level FROM x""")
def s3(spark, d):
    base = materialize(streaming.baseline_table(as_events(table(spark, d, "events"))))
    out = drain(streaming.stream_monitor(event_stream(spark, d), base), "monitor")
    return rounded(_days(out).select("entity", "day", "n", "mean_metric", "error_share", "distance", "alert_level"))


@query("s4_stream_self_baseline", f"""WITH {WINDOWS}, b AS (SELECT entity, arg_min(mm, day) AS bm, arg_min(es, day) AS be FROM cl GROUP BY 1)
  SELECT entity, day, n, {R('mm', 'mean_metric')}, {R('es', 'error_share')}, {R('sqrt((mm - bm) ** 2 + (es - be) ** 2)', 'distance')},
    CASE WHEN sqrt((mm - bm) ** 2 + (es - be) ** 2) > 15e-2 THEN 1 ELSE 0 END AS drift FROM cl JOIN b USING (entity)""")
def s4(spark, d):
    with streaming.rocksdb_state(spark):
        out = drain(streaming.stream_self_baseline(event_stream(spark, d)), "self_baseline")
    return rounded(_days(out).select("entity", "day", "n", "mean_metric", "error_share", "distance", "drift"))
