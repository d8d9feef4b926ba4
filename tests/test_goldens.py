"""Published results reproduced by hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from driftengine.operators import evaluate, stats


# Published mean distance and row count per period.
GOLDEN_PERIODS = [
    (2009, 4.626892930586086, 1898), (2010, 5.988865466885655, 706), (2011, 8.675279054494943, 494),
    (2012, 10.980668536929853, 240), (2013, 11.53770946741843, 423), (2014, 11.937575270784462, 260),
    (2015, 13.832423501639488, 129), (2016, 15.428341806835688, 386), (2017, 16.574074074074073, 54),
]


def expand(spark, cells):
    rows = [(i, j) for (i, j), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "x int, y int")


def test_chi2_of_a_2x2_table(spark):
    d = expand(spark, {(1, 1): 14, (1, 0): 1, (0, 1): 9, (0, 0): 6})
    r = stats.chi2_2x2(d, F.col("x") == 1, F.col("y") == 1).first()
    assert (round(r.chi2, 4), round(r.p, 6), round(r.cramers_v, 4), round(r.enrichment, 4)) == (4.6584, 0.030902, 0.3941, 1.5556)
    same = stats.chi2_contingency(d, "x", "y").first()
    assert (round(same.chi2, 4), round(same.p, 6), round(same.cramers_v, 4)) == (4.6584, 0.030902, 0.3941)


def test_bh_adjusted_p_values(spark):
    p = [1e-300, 1e-300, 0.39046438, 0.90804]
    d = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(p)], "test string, p_raw double")
    got = {r.test: (r.p_bh_adjusted, r.reject) for r in stats.bh_adjust(d).collect()}
    want = [2e-300, 2e-300, 0.52061918, 0.90804]
    for i, w in enumerate(want):
        assert got[f"t{i}"][0] == pytest.approx(w, rel=1e-6)
    assert [got[f"t{i}"][1] for i in range(4)] == [True, True, False, False]


def test_rate_of_the_published_period_means(spark):
    rows = GOLDEN_PERIODS
    d = spark.createDataFrame(rows, "period int, mean double, n int")
    t = (F.col("period") - 2009).cast("double")
    r = stats.rate_through_origin(d, t, F.col("mean"), F.col("n").cast("double")).first()
    assert round(r.rate, 4) == 2.5552


def test_confusion_metrics(spark):
    d = expand(spark, {(0, 0): 175, (0, 1): 40, (1, 0): 32, (1, 1): 153})
    r = evaluate.binary_metrics(d.withColumn("p", F.col("y") * 0.8 + 0.1), "x", "p").first()
    assert (r.tn, r.fp, r.fn, r.tp) == (175, 40, 32, 153)
    assert [round(v, 4) for v in (r.accuracy, r.precision, r.recall, r.f1)] == [0.82, 0.7927, 0.827, 0.8095]


def test_ensemble_votes_bands_and_missing_model(spark):
    rows = [(1, 0.9, 0.8, 0.9, None), (2, 0.1, 0.2, 0.0, 0.3), (3, 0.6, 0.4, 0.9, 0.2), (4, 0.6, 0.1, 0.1, 0.1)]
    d = spark.createDataFrame(rows, "v int, a double, b double, c double, d double")
    e = evaluate.ensemble(d, ["a", "b", "c", "d"])
    got = {r.v: (round(r.ensemble_prob, 4), r.models_predict_drift, r.confidence, r.agree) for r in e.collect()}
    assert got[1] == (0.8667, 4, "HIGH", True)
    assert got[2] == (0.15, 0, "NORMAL", True)
    assert got[3] == (0.525, 2, "MEDIUM", False)
    assert got[4] == (0.225, 1, "LOW", False)
    s = evaluate.ensemble_summary(e).first()
    assert (s.agreement_pct, s.status) == (50.0, "FAIL")
