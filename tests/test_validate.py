"""Intervals, cross-validation, backtests, sparse components and lazy selection against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from driftengine.operators import evaluate, linear, lloyd, models, pairs, sampling, sparse, validate
from driftengine.scale import materialize


def placements(y, s):
    pos, neg = s[y == 1], s[y == 0]
    above = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    return above.mean(axis=1), above.mean(axis=0)


def scored_rows(n=300, seed=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    a = np.round(rng.normal(size=n) + y, 1)  # ties
    return y, a, np.round(a + rng.normal(size=n), 1)


def test_auc_interval_is_delong(spark):
    y, a, _ = scored_rows()
    rows = [(int(v), float(s), "x") for v, s in zip(y, a)] + [(1, 0.5, "one class"), (None, 1.0, "x"), (1, None, "x"),
                                                             (1, 0.1, "two rows"), (0, 0.9, "two rows")]
    got = {r.g: r for r in evaluate.auc_interval(spark.createDataFrame(rows, "y int, s double, g string"), "y", "s", by=["g"]).collect()}
    v10, v01 = placements(y, a)
    se = math.sqrt(v10.var(ddof=1) / len(v10) + v01.var(ddof=1) / len(v01))
    r = got["x"]
    assert (r.n_pos, r.n_neg) == (y.sum(), len(y) - y.sum())
    assert [r.auc, r.auc_se] == pytest.approx([v10.mean(), se], rel=1e-9)
    assert [r.auc_lo, r.auc_hi] == pytest.approx([v10.mean() - 1.959963984540054 * se, v10.mean() + 1.959963984540054 * se], rel=1e-9)
    assert got["one class"].auc is None and got["one class"].auc_lo is None
    assert got["two rows"].auc == 0 and got["two rows"].auc_se is None


def test_auc_difference_uses_the_pairing(spark):
    y, a, b = scored_rows()
    df = spark.createDataFrame([(int(v), float(s), float(t)) for v, s, t in zip(y, a, b)] + [(1, None, 1.0)], "y int, a double, b double")
    r = evaluate.auc_difference(df, "y", "a", "b").first()
    (a10, a01), (b10, b01) = placements(y, a), placements(y, b)
    se = math.sqrt((a10 - b10).var(ddof=1) / len(a10) + (a01 - b01).var(ddof=1) / len(a01))
    assert [r.auc_a, r.auc_b, r.delta_se] == pytest.approx([a10.mean(), b10.mean(), se], rel=1e-9)
    assert r.delta_lo < r.delta < r.delta_hi and 0 <= r.p <= 1
    same = evaluate.auc_difference(df, "y", "a", "a").first()
    assert (same.delta, same.delta_se, same.p) == (0.0, pytest.approx(0, abs=1e-9), pytest.approx(1.0))
    assert evaluate.auc_difference(df.limit(0), "y", "a", "b").first().delta is None


def test_ablation_has_intervals(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, int(v), float(p), float(q)) for i, (v, (p, q)) in enumerate(zip(y, x))], "id long, label int, p double, q double")
    got = {r.group: r for r in models.ablation(df.where("id < 200"), df.where("id >= 200"), ["p", "q"], {"p": ["p"], "q": ["q"]},
                                              lambda t, f: models.fit_logistic(t, f)).collect()}
    assert got["full"].delta_lo == got["full"].delta_auc == got["full"].delta_hi == 0.0
    for name in ("p", "q"):
        r = got[name]
        assert r.delta_lo <= r.delta_auc <= r.delta_hi and r.auc_lo <= r.auc_ablated <= r.auc_hi
    assert got["p"].delta_hi < 0  # without the strong feature the model is surely worse


def test_fitted_classifiers_score_in_a_session_that_observed_a_query(spark):
    """Training summaries hold the session, which no longer goes to tasks once a query was observed."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    df = materialize(spark.createDataFrame(
        [(i, int(p + q > 0), float(p), float(q), [float(p), float(q)]) for i, (p, q) in enumerate(x)],
        "id long, label int, p double, q double, e array<double>"))
    fitted = [models.fit_logistic(df, ["p", "q"]), models.fit_forest(df, ["p", "q"], trees=3, depth=2)]
    scores = [lambda rows, m=m: models.predict(m, rows) for m in fitted] + [models.fit_on_embeddings(df, "e")[1]]
    for score in scores:
        rows = materialize(score(df)).collect()
        assert len(rows) == 60 and np.mean([(r.prob >= 0.5) == (r.label == 1) for r in rows]) > 0.8


def test_trees_are_fitted_on_all_cores(spark, monkeypatch):
    """Rows of a small join come in one partition; fitting many trees needs them dealt."""
    seen = []

    class Trees(Estimator):
        def _fit(self, dataset):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
            return VectorAssembler(inputCols=["p"], outputCol="out")

    df = spark.range(50).selectExpr("id", "double(id) AS p").coalesce(1)
    models._fit_trees(Trees(), df, ["p"])
    monkeypatch.setattr(models, "TREE_ROWS", 50)
    models._fit_trees(Trees(), df, ["p"])
    assert seen == [(1, 50), (2 * spark.sparkContext.defaultParallelism, 50)]


def test_scores_come_from_models_without_the_row(spark):
    """A lookup of the label by key is perfect on rows that were fitted and knows nothing of others."""
    df = spark.createDataFrame([(i, i % 2, 1.0) for i in range(200)], "id long, label int, x double")

    def remember(train, _):
        seen = {r.id: float(r.label) for r in train.collect()}
        lookup = F.udf(lambda i: seen.get(i, 0.5), "double")
        return lambda rows: rows.withColumn("prob", lookup("id"))

    folds = materialize(sampling.kfold(df, 4, "label"))
    scored = validate.cross_predict(folds, ["x"], {"memory": remember, "rule": F.col("x")})
    assert scored.count() == 400 and scored.where("model = 'memory' and prob <> 0.5").count() == 0
    metrics = validate.fold_metrics(scored)
    summary = {r.model: r for r in validate.cv_summary(metrics).collect()}
    assert summary["memory"].n_folds == 4 and summary["memory"].auc_mean == 0.5 and summary["memory"].auc_std == 0.0


def test_folds_without_a_class_are_left_out(spark):
    rows = [(i, int(i >= 100), float(i), 2000 + i // 100) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, x double, period int")
    folds = spark.createDataFrame([("early", 2001, 2001, 2002), ("late", 2002, 2002, 2003)], "fold string, train_max int, test_min int, test_max int")
    tagged = sampling.temporal_folds(df, folds)
    scored = validate.cross_predict(tagged, ["x"], {"g": lambda t, f: validate.fit_gaussian(t, f)}, balanced=True)
    assert {r.fold for r in scored.select("fold").distinct().collect()} == {"late"} and scored.count() == 100
    assert validate.cross_predict(tagged.where("fold = 'early'"), ["x"], {"r": F.col("x")}).collect() == []


def test_gaussian_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 1.0)], "label int, x double")
    with pytest.raises(ValueError):
        validate.fit_gaussian(df, ["x"])


def test_prefix_backtest_equals_a_fit_for_every_period(spark):
    rng = random.Random(5)
    rows = [(t, rng.choice("abc"), rng.gauss(0, 1) + 1e6, rng.gauss(0, 2)) for t in range(8) for _ in range(15)]
    rows = [(t, c, x + ord(c) - 97, y) for t, c, x, y in rows] + [(3, None, 1.0, 1.0), (4, "a", None, 0.0)]
    df = spark.createDataFrame(rows, "period int, label string, x double, y double")
    got = validate.prefix_backtest(df, ["x", "y"], "label").collect()
    known = [r for r in rows if None not in r]
    want = []
    for t, c, x, y in known:
        train = [r for r in known if r[0] < t]
        if t < 2:
            continue
        classes = sorted({r[1] for r in train})
        arr = {k: np.array([r[2:] for r in train if r[1] == k]) for k in classes}
        pooled = sum(((a - a.mean(axis=0)) ** 2).sum(axis=0) for a in arr.values()) / (len(train) - len(classes))
        score = {k: math.log(len(a) / len(train)) - ((np.array([x, y]) - a.mean(axis=0)) ** 2 / (2 * pooled)).sum() for k, a in arr.items()}
        best = min(classes, key=lambda k: (-score[k], k))
        want.append((t, c, x, y, t, best, int(best == c)))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("scale, n_rows", [(True, None), (False, 45)])
def test_sparse_components_are_those_of_the_dense_table(spark, scale, n_rows):
    rng = np.random.default_rng(7)
    dense = rng.poisson(0.6, (40, 30)) * np.linspace(3, 1, 30)
    dense[:, 0] = 0
    entries = [(i, f"t{j}", float(v)) for (i, j), v in np.ndenumerate(dense) if v]
    full = np.vstack([dense[dense.any(axis=1)], np.zeros(((n_rows or 0) - int(dense.any(axis=1).sum()) if n_rows else 0, 30))])
    x = full - full.mean(axis=0)
    sd = x.std(axis=0, ddof=1)
    x = x / np.where(sd > 0, sd, 1) if scale else x
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    df = spark.createDataFrame(entries + [(None, "t1", 1.0), (1, None, 1.0)], "id long, kmer string, freq double")
    scores, table = sparse.sparse_pca(df, 6, n_rows=n_rows, scale=scale)
    got = table.orderBy("component").collect()
    assert [r.explained for r in got] == pytest.approx((want / want.sum())[:6], rel=1e-4)
    p = np.array([r.pca for r in scores.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.abs(p) == pytest.approx(np.abs((u * s)[:len(p), :6]), abs=0.05 * s[0])
    assert sparse.sparse_pca(df.limit(0), 3)[1].collect() == []


def test_components_are_found_without_joining_entries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    entries = [(f"r{i}", f"t{j}", float(v)) for (i, j), v in np.ndenumerate(rng.poisson(0.5, (60, 25))) if v]
    entries += [("same", "t3", 2.0), ("same", "t3", 1.0), ("alone", "once", 0.0)]
    df = spark.createDataFrame(entries, "id string, kmer string, freq double")
    monkeypatch.setattr(sparse, "ROUNDS", 2)
    # Rows in pieces over all tasks, entries joined with a distributed block.
    want_scores, want = (x.collect() for x in sparse.sparse_pca(df.repartition(7, "kmer"), 5, n_rows=70, block_bytes=0))

    def joined(*args, **kw):
        raise AssertionError("the entries were joined")

    monkeypatch.setattr(sparse, "dim_join", joined)
    monkeypatch.setattr(sparse, "STRETCH", 16)
    got_scores, got = (x.collect() for x in sparse.sparse_pca(df, 5, n_rows=70))
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]
    by_id = {r.id: np.abs(r.pca) for r in want_scores}
    assert len(got_scores) == len(by_id) == 61  # no term of "alone" varies
    assert all(np.abs(r.pca) == pytest.approx(by_id[r.id], abs=1e-6) for r in got_scores)


def test_pool_gives_the_same_picks_as_all_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, "gh"[i % 2], "".join(rng.choice("ACGT") for _ in range(rng.choice([8, 9, 12])))) for i in range(80)]
    rows += [(100, "small", "AC"), (101, "small", "AG"), (102, "g", None)]
    df = spark.createDataFrame(rows, "id long, grp string, sequence string")

    def brute(group, quota):
        mine = {i: s for i, g, s in rows if g == group and s is not None}
        diff = lambda a, b: sum(x != y for x, y in zip(a, b)) / min(len(a), len(b))
        total = lambda i: sum(sum(x != y for x, y in zip(mine[i], t)) + abs(len(mine[i]) - len(t)) for t in mine.values())
        picks = [min(mine, key=lambda i: (total(i), i))]
        while len(picks) < min(quota, len(mine)):
            picks.append(min((i for i in mine if i not in picks), key=lambda i: (-min(diff(mine[i], mine[p]) for p in picks), i)))
        return picks

    want = {g: brute(g, 7) for g in ("g", "h", "small")}
    for pool, chars in ((32, 8 << 20), (2, 8 << 20), (3, 0)):
        monkeypatch.setattr(pairs, "POOL", pool)
        monkeypatch.setattr(pairs, "PICK_CHARS", chars)
        got = pairs.diverse_select(df, "grp", 7).orderBy("grp", "pick").collect()
        assert {g: [r.id for r in got if r.grp == g] for g in want} == want


def test_newton_finds_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 100, 0] + [0, 1e4, 7]
    y = (x[:, 0] + x[:, 1] / 100 - 100 + rng.logistic(size=500) > 0).astype(int)
    df = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)] + [(1, None, 1.0, 7.0), (None, 1.0, 1.0, 7.0)],
                               "label int, a double, b double, c double")
    head = linear.fit_newton(df.repartition(5), ["a", "b", "c"], l2=1e-3)
    assert head.gradient < 1e-10 and head.weights[2] == 0
    p = 1 / (1 + np.exp(-(head.intercept + x @ head.weights)))
    sd, mean = x.std(axis=0), x.mean(axis=0)
    slope = ((p - y)[:, None] * (x - mean) / np.where(sd > 0, sd, 1)).mean(axis=0) + 1e-3 * head.weights * sd
    assert abs((p - y).mean()) < 1e-9 and np.abs(slope).max() < 1e-9
    got = head(df.where("a is not null and label is not null")).select("prob").toPandas()
    assert np.allclose(np.sort(got["prob"]), np.sort(p))
    # Perfectly separated rows have an optimum too.
    apart = spark.createDataFrame([(int(i > 5), float(i)) for i in range(12)], "label int, a double")
    assert linear.fit_newton(apart, ["a"], l2=1e-2).gradient < 1e-10
    with pytest.raises(ValueError):
        linear.fit_newton(df.limit(0), ["a"])


def test_lloyd_sweep_against_plain_rounds(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(500, None), (None, [0.0, 0.0])], "id long, v array<double>")
    table, centres = lloyd.lloyd_sweep(df.repartition(4), "v", (2, 3, 4, 500), "id")
    got = {r.K: r for r in table.collect()}
    assert set(got) == {2, 3, 4} and [r.K for r in got.values() if r.is_best] == [max(got, key=lambda k: got[k].silhouette_score)]
    for k, c in centres.items():
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert got[k].inertia == pytest.approx(d.min(axis=1).sum())
        assert all(np.allclose(x[near == i].mean(axis=0), c[i]) for i in range(k))  # nothing moves any more
        pair = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        s = []
        for i in range(len(x)):
            own = (near == near[i]).sum()
            b = min(pair[i][near == j].mean() for j in set(near) - {near[i]})
            a = pair[i][near == near[i]].sum() / max(own - 1, 1)
            s.append((b - a) / max(a, b) if own > 1 else 0.0)
        assert got[k].silhouette_score == pytest.approx(np.mean(s), rel=1e-6)
        assert df.where("id < 120").orderBy("id").select(lloyd.nearest("v", c).alias("c")).toPandas()["c"].tolist() == near.tolist()
    assert lloyd.lloyd_sweep(df.limit(0), "v", (2,), "id")[0].collect() == []


def test_map_has_no_more_stress_than_plain_scaling(spark, monkeypatch):
    rng = random.Random(6)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(5)]
    rows = [(i, "".join(c if rng.random() < 0.8 else rng.choice("ACGT") for c in base[i % 5])) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, sequence string")
    stress = {}
    for steps in (0, 1):
        monkeypatch.setattr(pairs, "MAP_STEPS", steps and 200)
        monkeypatch.setattr(pairs, "PLACE_STEPS", steps and 25)
        got = pairs.landmark_map(df, 20)
        assert got.count() == 120
        stress[steps] = pairs.map_stress(got).first().stress
    assert stress[1] < 0.8 * stress[0]
    one, many = (sorted((r.id, round(r.x, 9)) for r in pairs.landmark_map(df.repartition(n), 20).collect()) for n in (1, 7))
    assert one == many
    assert pairs.landmark_map(df.limit(0), 20).collect() == []
