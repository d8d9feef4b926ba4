"""Empty and awkward input, hot keys, plans and layouts."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from driftengine import scale
from driftengine.operators import clean, evaluate, models, profile, sampling, stats
from driftengine.sources import io

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("rows", [[], [(1, "g", None, None), (2, "g", None, None)]])
def test_empty_and_all_null_columns(spark, rows):
    d = spark.createDataFrame(rows, "id long, g string, v double, y int")
    assert profile.summary(d, "v", ["g"]).count() <= 1
    assert profile.summary(d, "v").first().n == 0
    assert profile.iqr_outliers(d, "v").where("outlier_high").count() == 0 if "outlier_high" in profile.iqr_outliers(d, "v").columns else True
    assert clean.bin_quantile(d, "v", 4).count() == len(rows)
    assert stats.split_at_quantile(d, "v").count() == len(rows)
    assert stats.mann_whitney(d, "v", F.col("y") == 1).first().u in (None, 0.0)
    assert stats.agreement(d, "v", "v").first().n == 0
    assert stats.bh_adjust(d, "v").count() == len(rows)
    assert evaluate.binary_metrics(d, "y", "v").count() <= 1
    assert evaluate.roc_points(d, "y", "v").count() >= 0
    assert scale.exact_quantiles(d, "v", {"m": 0.5}, ["g"]).count() == 0


def test_fasta_marks_inside_a_header(spark, tmp_path):
    (tmp_path / "f.fasta").write_text(">s1|2001|A->B site\nAC\nGT\n>s2|x|>\n\n>s3|2003|end\nT")
    got = {(r.id, r.period, r.place, r.sequence) for r in io.read_fasta(spark, str(tmp_path / "f.fasta")).collect()}
    assert got == {("s1", 2001, "A->B site", "ACGT"), ("s2", None, ">", ""), ("s3", 2003, "end", "T")}
    d = spark.createDataFrame([("a|b>", 1, "x\ny", "ACGT")], "id string, period int, place string, sequence string")
    io.write_fasta(d, str(tmp_path / "out"), ["id", "period", "place"])
    assert [tuple(r) for r in io.read_fasta(spark, str(tmp_path / "out")).collect()] == [("a_b_", 1, "x_y", "ACGT")]


def test_dedupe_does_not_depend_on_the_layout(spark):
    rows = [(i % 3, 7, i, {"a": i}) for i in range(30)]
    seen = set()
    for parts in (1, 3, 8, 16):
        d = spark.createDataFrame(rows, "k int, o int, x int, m map<string,int>").repartition(parts)
        seen.add(tuple(sorted((r.k, r.x) for r in profile.dedupe(d, ["k"], ["o"]).collect())))
    assert seen == {((0, 0), (1, 1), (2, 2))}


def test_queries_run_from_another_folder():
    code = f"""import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
print('ROWS', e.queries()['d18_cooccurrence_fisher'](spark, '/root/testdata/sf0.001').count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as folder:
        out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_lookups_are_equi_joins(spark):
    fact = spark.range(5000).selectExpr("cast(id % 900 as int) period", "id")
    dim = spark.createDataFrame([("a", 0, 300), ("wide", -10**9, 10**9), ("c", 500, 600)], "name string, start int, end int")
    j = scale.range_join(fact, "period", dim)
    assert "NestedLoop" not in plan(j) and "Cartesian" not in plan(j)
    assert j.count() == 5000 + fact.where("period < 300 or period between 500 and 599").count()
    folds = spark.createDataFrame([(1, 300, 300, 400), (2, 400, 400, 500)], "fold int, train_max int, test_min int, test_max int")
    rows = sampling.temporal_folds(fact, folds)
    assert "NestedLoop" not in plan(rows)
    assert rows.where("fold = 1 and role = 'test'").count() == fact.where("period between 300 and 399").count()


def test_segments_from_quantiles_agree(spark, monkeypatch):
    fact = spark.range(400).selectExpr("cast(id as int) x")
    dim = spark.range(300).selectExpr("cast(id as int) start", "cast(id + 1 + id % 7 as int) end", "id name")
    want = sorted(map(tuple, scale.range_join(fact, "x", dim, how="inner").select("x", "name").collect()))
    monkeypatch.setattr(scale, "SEGMENTS", 10)
    got = sorted(map(tuple, scale.range_join(fact, "x", dim, how="inner").select("x", "name").collect()))
    assert got == want and len(got) == sum(1 + i % 7 for i in range(300))


def test_lookup_with_nearly_all_rows_equal(spark):
    fact = spark.range(20000).selectExpr("case when id % 10 < 9 then 1 else id end k", "1 v")
    dim = spark.range(30000).selectExpr("id k", "id * 2 w")
    got = scale.dim_join(fact, dim, ["k"], "left", max_rows=0)
    assert got.count() == 20000 and got.where("w <> k * 2 or w is null").count() == 0


def test_forest_has_one_rule_at_every_size(spark):
    """A row joins trees by its own draw: the share of rows drawn follows the size, and nothing else."""
    for n in (200, 3000):
        d = spark.range(n).selectExpr("id", "cast(id % 97 as double) a", "cast(id % 89 as double) b")
        d = d.unionByName(spark.createDataFrame([(10**6, 500.0, -500.0)], "id long, a double, b double"))
        top = models.isolation_forest(d, ["a", "b"], 0.01, trees=40, sample=64).orderBy(F.desc("anomaly_score")).first()
        assert top.id == 10**6


def test_caller_metric_and_mcc(spark):
    d = spark.createDataFrame([(i, i % 2, 0.9 if (i % 2) ^ (i % 7 == 0) else 0.1) for i in range(300)], "id long, y int, p double")

    def balanced(tp, fp, fn, tn):
        return (tp / (tp + fn) + tn / (tn + fp)) / 2

    own = stats.bootstrap_metric(d, "y", "p", balanced, 100).first()
    mcc = stats.bootstrap_metric(d, "y", "p", "mcc", 100).first()
    assert own.metric == "balanced" and own.ci_lo < own.point < own.ci_hi
    assert mcc.point == pytest.approx(2 * own.point - 1, abs=0.01)


def test_chi2_of_nearly_independent_columns_does_not_cancel(spark):
    d = spark.range(40000).selectExpr("id % 2 a", "cast(id / 2 as long) % 2 b")
    assert stats.chi2_contingency(d, "a", "b").first().chi2 == pytest.approx(0.0, abs=1e-9)
    d = spark.createDataFrame([(0, 0)] * 5 + [(1, 1)] * 5, "a int, b int")
    assert stats.chi2_contingency(d, "a", "b").first().chi2 == pytest.approx(10.0)
