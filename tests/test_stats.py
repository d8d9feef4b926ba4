"""Statistics against closed forms and brute force; bootstraps on different layouts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftengine.functions.tails import (
    beta_reg,
    chi2_sf,
    fisher_greater,
    fisher_greater_value,
    gamma_upper,
    normal_sf,
    normal_two_sided,
    t_two_sided,
    t_two_sided_value,
)
from driftengine.operators import evaluate, models, series, stats


def test_tail_probabilities():
    assert t_two_sided_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert t_two_sided_value(0.0, 3) == pytest.approx(1.0)
    assert gamma_upper(0.5, 4.6584 / 2) == pytest.approx(0.030902, abs=1e-6)
    assert gamma_upper(5.0, 3.0) == pytest.approx(0.8152632, abs=1e-7)
    assert gamma_upper(1.0, 700.0) == pytest.approx(np.exp(-700.0), rel=1e-9)
    assert beta_reg(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert fisher_greater_value(8, 2, 1, 5) == pytest.approx(0.02447552, abs=1e-8)
    assert fisher_greater_value(0, 5, 5, 0) == 1.0
    assert fisher_greater_value(5, 0, 0, 5) == pytest.approx(1 / 252)


def test_tail_columns_pass_nulls(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3), (None, None, None)], "x double, k double, n int")
    r = d.select(normal_sf("x"), normal_two_sided("x"), t_two_sided("x", "k"), chi2_sf("x", "k"),
                 fisher_greater("n", "n", "n", "n")).collect()
    assert r[0][0] == pytest.approx(0.15865525, abs=1e-8) and r[0][1] == pytest.approx(2 * r[0][0])
    assert list(r[1]) == [None] * 5


def test_linear_trend_p_and_perfect_line(spark):
    d = spark.createDataFrame([("a", i, float(2 * i + 1)) for i in range(5)] + [("b", i, float(v)) for i, v in enumerate([1, 3, 2, 5])], "g string, x int, y double")
    got = {r.g: r for r in stats.linear_trend(d, "x", "y", ["g"]).collect()}
    assert (got["a"].slope, got["a"].p) == (pytest.approx(2.0), pytest.approx(0.0, abs=1e-12))
    assert got["b"].slope == pytest.approx(1.1) and got["b"].p == pytest.approx(0.1685, abs=1e-3)


def test_mann_whitney_against_pairs(spark):
    rng = random.Random(1)
    rows = [(float(rng.randint(0, 9)), rng.random() < 0.4) for _ in range(200)]
    d = spark.createDataFrame(rows, "v double, f boolean")
    r = stats.mann_whitney(d, "v", F.col("f")).first()
    one, two = [v for v, f in rows if f], [v for v, f in rows if not f]
    assert r.u == sum((a > b) + 0.5 * (a == b) for a in one for b in two)
    assert -1 <= r.rank_biserial <= 1 and 0 <= r.p <= 1


def test_bh_by_group_is_monotone_and_not_below_raw(spark):
    rng = random.Random(2)
    rows = [(f"g{i % 3}", rng.choice([0.01, 0.2, rng.random()])) for i in range(150)]
    d = spark.createDataFrame(rows, "g string, p_raw double")
    for g in range(3):
        own = sorted((r.p_raw, r.p_bh_adjusted) for r in stats.bh_adjust(d, by=["g"]).where(f"g = 'g{g}'").collect())
        p = np.array([a for a, _ in own])
        n = len(p)
        want = np.minimum(1, np.minimum.accumulate((p * n / np.arange(1, n + 1))[::-1])[::-1])
        assert [b for _, b in own] == pytest.approx(want.tolist())
        assert all(b >= a for a, b in own)


def test_bootstraps_do_not_depend_on_the_layout(spark):
    rng = random.Random(4)
    rows = [(i, int(rng.random() < 0.5), round(rng.random(), 2)) for i in range(400)]
    base = spark.createDataFrame(rows, "id long, y int, p double")
    seen = []
    for parts in (1, 8, 64):
        d = base.repartition(parts)
        seen.append((
            [round(v, 9) for v in stats.bootstrap_mean(d, "p", 100).first()],
            [round(v, 9) for v in stats.bootstrap_metric(d, "y", "p", "auc", 40).first()[1:]],
            [round(v, 9) for v in stats.bootstrap_metric(d, "y", "p", "f1", 100, stratify=True).first()[1:]],
        ))
    assert seen[0] == seen[1] == seen[2]
    mean = np.mean([r[2] for r in rows])
    assert seen[0][0][2] < mean < seen[0][0][3]
    half = 1.96 * np.std([r[2] for r in rows]) / 20
    assert seen[0][0][4] == pytest.approx(2 * half, rel=0.35)


def test_metrics_with_one_class_and_ties(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.5), ("b", 0, 0.5)], "g string, y int, p double")
    got = {r.g: r for r in evaluate.binary_metrics(d, "y", "p", by=["g"]).collect()}
    assert got["a"].auc == 0.5 and got["b"].auc == 0.5
    assert got["a"].mcc == 0.0 and got["a"].f1 == 1.0
    points = evaluate.roc_points(d.where("g = 'b'"), "y", "p").collect()
    assert [(p.tpr, p.fpr) for p in points] == [(1.0, 1.0)]


def test_purity_bounds(spark):
    d = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (2, "x")], "c int, l string")
    got = {r.c: (r.dominant, r.purity) for r in evaluate.purity(d, "c", "l").collect()}
    assert got == {1: ("x", pytest.approx(2 / 3)), 2: ("x", 0.5)}
    assert evaluate.purity_overall(d, "c", "l").first().verdict == "MARGINAL"


def test_quadratic_fit_recovers_coefficients(spark):
    rows = [("a", i, 0.5 * i * i - 3 * i + 2.0) for i in range(100, 120)]
    d = spark.createDataFrame(rows, "g string, x int, y double")
    r = series.poly_fit(d, "x", "y", ["g"]).first()
    assert (r.c2, r.c1, r.c0) == (pytest.approx(0.5), pytest.approx(-3.0), pytest.approx(2.0, abs=1e-3))
    assert r.r2 == pytest.approx(1.0) and r.trajectory == "Accelerating"


def test_forecast_of_a_random_walk_uses_differences(spark):
    rows = [("a", i, float(i + (i % 2) * 0.1)) for i in range(30)]
    d = spark.createDataFrame(rows, "g string, period int, y double")
    got = series.ar1_forecast(d, "y", 3, by=["g"]).orderBy("step").collect()
    assert [r.d for r in got] == [1, 1, 1]
    assert got[0].ci_lower < got[0].forecast < got[0].ci_upper
    assert got[2].forecast == pytest.approx(32.0, abs=0.5)


def test_adaptive_forecast_falls_back_to_the_overall_mean(spark):
    d = spark.createDataFrame([(2000, 0.9, 0.7, 0.3), (2000, 0.1, 0.2, 0.8)], "period int, prob double, a double, b double")
    t = spark.createDataFrame([(2001,), (2050,)], "period int")
    got = {r.period: (r.n, r.width, r.forecast) for r in series.adaptive_forecast(d, t, ["a", "b"]).collect()}
    assert got == {2001: (1, 15, 0), 2050: (0, None, 1)}


def test_control_check_on_planted_drift(spark):
    flat = [(2000 + i, 5.0 + (-1) ** i * 0.1, 10) for i in range(9)]
    drift = [(2009 + i, 2.0 * i, 10) for i in range(9)]
    d = spark.createDataFrame(flat + drift, "period int, mean_distance double, sample_size int")
    r = stats.control_check(d, 2009).first()
    assert r.positive_control and r.negative_control


def test_silhouette_rows_against_pairs(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(c, 1, (15, 3)) for c in (0, 4, 9)])
    labels = np.repeat([0, 1, 2], 15)
    rows = [(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(X, labels))]
    d = spark.createDataFrame(rows, "id long, v array<double>, cluster int")
    got = {r.id: r.silhouette for r in models.silhouette_rows(d, "v").collect()}
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    for i in range(len(X)):
        a = D[i, labels == labels[i]].sum() / 14
        b = min(D[i, labels == c].mean() for c in range(3) if c != labels[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_isolation_forest_flags_planted_rows_on_any_layout(spark):
    rng = random.Random(9)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(290)] + [(900 + i, 9.0 + i, -9.0 - i) for i in range(10)]
    seen = []
    for parts in (1, 8):
        d = spark.createDataFrame(rows, "id long, a double, b double").repartition(parts)
        out = models.isolation_forest(d, ["a", "b"], 0.05, trees=30, sample=64)
        seen.append({r.id for r in out.where("is_anomaly = 1").collect()})
    assert seen[0] == seen[1] and {900 + i for i in range(10)} <= seen[0] and len(seen[0]) == 15


def test_rows_go_down_flat_trees_as_down_nested_ones():
    rng = np.random.default_rng(2)
    X = np.column_stack([rng.integers(0, 9, 500), rng.random(500), np.zeros(500)])
    X[3], X[4, 1] = np.nan, np.nan
    trees = [models._grow(X[10:][rng.integers(0, 490, 64)], np.random.default_rng(t), 0, 6) for t in range(12)] + [[1]]

    def length(node, row, depth=0):
        if len(node) == 1:
            return depth + models._path_average(node[0])
        return length(node[2] if row[node[0]] < node[1] else node[3], row, depth + 1)

    got = models._path_lengths([models._flat(t) for t in trees], X, 6)
    want = np.zeros(500)
    for t in trees:
        want += [length(t, row) for row in X]
    assert (got == want).all()


def test_backtest_uses_only_earlier_periods(spark):
    rows = [(t, k, float(t % 2), "u" if t % 2 else "v") for t in range(8) for k in range(6)]
    d = spark.createDataFrame(rows, "period int, k int, f double, label string")
    hits, rates = models.backtest(d, ["f"], "label", {"tree": lambda t, f: models.fit_tree(t, f, "__code", 2)})
    assert hits.agg(F.min("period")).first()[0] == 2
    assert rates.first().hit_rate == 1.0


def test_degenerate_inputs_give_nulls_not_errors(spark):
    from driftengine.operators import joins, sequence

    d = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0)], "g string, x int, v double")
    yes = F.col("v") > 0
    assert stats.mann_whitney(d, "v", yes).first().z is None
    assert stats.t_test(d, "v", yes).first().t is None
    assert stats.rate_through_origin(d.where("x = 0"), F.col("x"), F.col("v")).first().rate is None
    assert stats.chi2_2x2(d.where("x > 9"), yes, yes).first().cramers_v is None
    assert stats.linear_trend(d, "x", "v", ["g"]).where("p IS NOT NULL").count() == 0
    assert series.poly_fit(d, "x", "v", ["g"]).where("c2 IS NOT NULL").count() == 0
    assert series.ar1_forecast(d.withColumn("period", F.col("x")), "v", 2, by=["g"]).where("forecast IS NOT NULL").count() == 0
    assert stats.corr_ci(spark.createDataFrame([(0.5, 3)], "r double, n int"), "r", "n").first().ci_lo is None
    assert stats.z_test(spark.createDataFrame([(0.5, 0.0)], "m double, se double"), "m", 0.0, "se").first().z is None
    ev = spark.createDataFrame([("e", 1)], "event string, t int")
    only = joins.pre_post(spark.createDataFrame([(0, 2.0)], "period int, v double"), ev, 2, "v").first()
    assert (only.pre_mean, only.post_mean, only.n_post) == (2.0, None, 0)
    assert evaluate.ensemble(spark.createDataFrame([(None, None)], "a double, b double"), ["a", "b"]).first().ensemble_prob is None
    r = spark.createDataFrame([(1, "x", 1, "")], "id long, grp string, period int, sequence string")
    ref = sequence.modal_reference(r)
    reg = spark.createDataFrame([("x", "r", 0, 2)], "grp string, region string, start int, end int")
    assert sequence.region_enrichment(sequence.diff_events(r, ref), r, ref, reg).first().enrichment == 1.0
