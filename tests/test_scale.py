"""Helpers that replace one-task windows and unchecked broadcasts, against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftengine import scale
from driftengine.operators import clean, sampling, sequence


def skewed(spark, n=4000, partitions=8):
    """Two thirds of the rows in one group, heavy ties."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"g{i % 11}", rng.choice([0.0, 1.0, 1.0, 1.0, 2.0, 5.0, rng.random()])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(partitions)


def test_running_totals_match_a_window(spark):
    counts = skewed(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    want = {tuple(r) for r in counts.select("g", "v", F.sum("n").over(w).alias("c")).collect()}
    got = scale.running_totals(counts, "v", {"n": "c"}, ["g"], buckets=7)
    assert {(r.g, r.v, r.c) for r in got.collect()} == want


def test_running_min_descending(spark):
    d = spark.createDataFrame([(float(i), float((i * 7) % 10)) for i in range(50)], "x double, y double")
    got = scale.running_totals(d, "x", {"y": "m"}, descending=True, fn="min", buckets=5)
    rows = {r.x: r.m for r in got.collect()}
    for i in range(50):
        assert rows[float(i)] == min((j * 7) % 10 for j in range(i, 50))


def test_null_group_is_kept(spark):
    d = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 1), ("a", 1.0, 1)], "g string, v double, n long")
    got = {(r.g, r.v): r.c for r in scale.running_totals(d, "v", {"n": "c"}, ["g"]).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, ("a", 1.0): 1}


def test_hash_rank_matches_a_window_and_ignores_the_layout(spark):
    w = Window.partitionBy("g").orderBy(scale.hash_order("id"), "id")
    seen = []
    for parts in (1, 8, 64):
        d = skewed(spark, partitions=parts)
        want = {r.id: r.rn for r in d.select("id", F.row_number().over(w).alias("rn")).collect()}
        got = {r.id: r["rank"] for r in scale.hash_rank(d, ["g"], "id").collect()}
        assert got == want
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


def test_hash_rank_with_quota_keeps_exactly_the_first(spark):
    d = skewed(spark)
    full = scale.hash_rank(d, ["g"], "id").where("rank <= 17")
    cut = scale.hash_rank(d, ["g"], "id", quota=17)
    assert {r.id for r in cut.collect()} == {r.id for r in full.collect()}


@pytest.mark.parametrize("max_rows", [None, 0])
def test_dim_join_same_rows_when_too_large_to_broadcast(spark, max_rows):
    d = skewed(spark)
    dim = d.select("g").distinct().withColumn("len", F.length("g")).where("g <> 'g3'")
    got = scale.dim_join(d, dim, ["g"], "left", max_rows=max_rows)
    assert got.count() == d.count()
    bad = got.where("(g = 'g3' AND len IS NOT NULL) OR (g <> 'g3' AND len <> length(g))")
    assert bad.count() == 0


@pytest.mark.parametrize("max_rows", [None, 0])
def test_range_join_broadcast_and_bucketed_agree(spark, max_rows):
    d = spark.createDataFrame([(i,) for i in range(-5, 40)] + [(None,)], "x int")
    dim = spark.createDataFrame([("a", 0, 10), ("b", 8, 12), ("c", 20, 39)], "name string, start int, end int")
    got = scale.range_join(d, "x", dim, max_rows=max_rows)
    want = sorted([(x, n) for x in range(-5, 40) for n, s, e in (("a", 0, 10), ("b", 8, 12), ("c", 20, 39)) if s <= x < e])
    assert sorted((r.x, r.name) for r in got.where("name IS NOT NULL").collect()) == want
    assert got.where("name IS NULL").count() == 46 - len({x for x, _ in want})


def test_exact_quantiles_with_ties(spark):
    d = skewed(spark)
    got = {r.g: (r.a, r.b) for r in scale.exact_quantiles(d, "v", {"a": 0.5, "b": 0.9}, ["g"]).collect()}
    want = d.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.9)).alias("b"))
    for r in want.collect():
        assert got[r.g] == pytest.approx((r.a, r.b))


def test_rank_join_keeps_hot_cold_and_null_values(spark):
    rows = [(i, 1.0 if i % 2 else float(i)) for i in range(3000)] + [(9999, None)]
    d = spark.createDataFrame(rows, "id long, v double")
    ranks = scale.value_ranks(d, "v")
    got = scale.rank_join(d, "v", ranks, ["cum"])
    assert got.count() == 3001
    assert got.where("v = 1.0 AND cum <> 1501").count() == 0
    assert got.where("v IS NULL AND cum IS NULL").count() == 1


def test_mode_prefers_smallest_on_ties(spark):
    d = spark.createDataFrame([("x", 3), ("x", 2), ("x", 3), ("x", 2), ("y", 1)], "g string, v int")
    assert {tuple(r) for r in scale.most_frequent(d, ["g"], "v").collect()} == {("x", 2, 2), ("y", 1, 1)}


def test_samples_have_exact_sizes_on_any_layout(spark):
    rows = [(i, f"s{min(i % 9, 5)}", i % 2) for i in range(900)]
    picked = []
    for parts in (1, 8, 64):
        d = spark.createDataFrame(rows, "id long, s string, label int").repartition(parts)
        a = {r.id for r in sampling.sample_proportional(d, "s", 101).collect()}
        b = {r.id for r in sampling.sample_boosted(d, "s", "s5", 0.5, 300).collect()}
        c = {r.id for r in sampling.sample_even(d, "s", 60).collect()}
        assert (len(a), len(b), len(c)) == (101, 300, 60)
        picked.append((a, b, c))
    assert picked[0] == picked[1] == picked[2]


def test_proportional_sample_with_more_strata_than_rows(spark):
    d = spark.createDataFrame([(i, f"s{i}") for i in range(50)], "id long, s string")
    assert sampling.sample_proportional(d, "s", 20).count() == 20
    assert sampling.sample_even(d, "s", 20).count() == 20
    assert sampling.sample_proportional(d, "s", 80).count() == 50


def test_split_parts_are_disjoint_and_complete(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, label int")
    parts = sampling.split(d, "label").collect()
    assert len(parts) == 300 and len({r.id for r in parts}) == 300
    for label in range(3):
        sizes = [sum(r.label == label and r.part == p for r in parts) for p in ("train", "validation", "test")]
        assert sizes == [60, 20, 20]


def test_edge_labels(spark):
    dim = spark.createDataFrame([("a", 10, 20, 0), ("b", 20, 30, 1)], "name string, start int, end int, ordinal int")
    d = spark.createDataFrame([(5,), (10,), (19,), (20,), (30,), (None,)], "period int")
    got = {r.period: r.label for r in clean.label_interval(d, dim).collect()}
    assert got == {5: "Other", 10: "a", 19: "a", 20: "b", 30: "Other", None: "Unknown"}
    got = {r.period: (r.cluster_name, r.label) for r in clean.label_ordinal(d, dim, 1).collect()}
    assert got == {5: ("a", 0), 10: ("a", 0), 19: ("a", 0), 20: ("b", 1), 30: ("b", 1), None: (None, None)}


def test_coerce_int_drops_bad_text(spark):
    d = spark.createDataFrame([("2001",), (" 7 ",), ("x",), (None,), ("3.0",), ("NaN",)], "p string")
    assert sorted(r.p for r in clean.coerce_int(d, "p").collect()) == [3, 7, 2001]


def test_plan_of_diff_events_has_no_shuffle(spark):
    d = spark.createDataFrame([(1, "a", 1, "xyz")], "id long, grp string, period int, sequence string")
    ref = spark.createDataFrame([("a", "xxz", 3)], "grp string, ref string, ref_length int")
    plan = sequence.diff_events(d, ref)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
