"""Sequence operators on edge cases and against brute force."""

import datetime
import math
import random
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftengine.functions.columns import hamming, hamming_arrow
from driftengine.operators import joins, metric, pairs, sequence, series
from driftengine.sources import io


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, period int, sequence string")


def random_records(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xy"), 2000 + i % 4, "".join(rng.choice("ABC") for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return rows, records(spark, rows)


def brute_hamming(a, b, normalize=True, empty=1.0, pad=False):
    n = min(len(a), len(b))
    if n == 0:
        return empty
    m = sum(x != y for x, y in zip(a, b)) + (abs(len(a) - len(b)) if pad else 0)
    return m / n if normalize else float(m)


@pytest.mark.parametrize("options", [{}, {"normalize": False}, {"pad": True}, {"empty": 0.0}])
def test_hamming_variants(spark, options):
    pairs_ = [("", ""), ("", "ab"), ("abc", "abd"), ("abcd", "ab"), ("ééa", "eéa"), ("a😀b", "a😀c")]
    d = spark.createDataFrame(pairs_, "a string, b string")
    for h in (hamming, hamming_arrow):
        got = [r[0] for r in d.select(h(F.col("a"), F.col("b"), **options)).collect()]
        assert got == pytest.approx([brute_hamming(a, b, **options) for a, b in pairs_])
        flipped = [r[0] for r in d.select(h(F.col("b"), F.col("a"), **options)).collect()]
        assert flipped == got


def test_hamming_null_and_case(spark):
    d = spark.createDataFrame([("Ab", "aB"), (None, "a")], "a string, b string")
    for h in (hamming, hamming_arrow):
        assert [r[0] for r in d.select(h(F.col("a"), F.col("b"), ignore_case=True)).collect()] == [0.0, None]


def test_modal_reference_ties_nulls_and_fallback(spark):
    d = records(spark, [(1, "x", 1, "B"), (2, "x", 1, "A"), (3, "x", 2, "A"), (4, "x", 1, "B"), (5, "y", 1, None), (6, "y", 1, "")])
    assert {(r.grp, r.ref, r.n_ref) for r in sequence.modal_reference(d).collect()} == {("x", "A", 2), ("y", "", 1)}
    first = sequence.modal_reference(d, where=F.col("period") == 1)
    assert {(r.grp, r.ref, r.n_ref) for r in first.collect()} == {("x", "B", 2), ("y", "", 1)}
    none = sequence.modal_reference(d, where=F.col("period") == 9)
    assert {(r.grp, r.ref) for r in none.collect()} == {("x", "A"), ("y", "")}


def test_events_equal_distances_and_positions(spark):
    rows, d = random_records(spark)
    ref = sequence.modal_reference(d)
    refs = {r.grp: r.ref for r in ref.collect()}
    ev = {(r.id, r.position): (r.ref_char, r.var_char) for r in sequence.diff_events(d, ref).collect()}
    want = {(i, p): (a, b) for i, g, _, s in rows for p, (b, a) in enumerate(zip(s, refs[g])) if a != b}
    assert ev == want
    dist = sequence.distance_to_reference(d, ref)
    for r in dist.collect():
        assert r.distance == pytest.approx(brute_hamming(r.sequence, refs[r.grp]) * len(refs[r.grp]))


def test_entropy_is_bounded_and_exact(spark):
    rows, d = random_records(spark)
    for r in sequence.position_entropy(d).collect():
        c = Counter(s[r.position] for _, g, _, s in rows if g == r.grp and len(s) > r.position)
        t = sum(c.values())
        assert r.entropy == pytest.approx(-sum(n / t * math.log2(n / t) for n in c.values()), abs=1e-9)
        assert 0 <= r.entropy <= math.log2(3) + 1e-9


def test_empty_sequence_adds_no_events_or_kmers(spark):
    d = records(spark, [(1, "x", 1, ""), (2, "x", 1, "AB"), (3, "x", 1, "AB"), (4, "x", 1, None)])
    ref = sequence.modal_reference(d)
    assert sequence.diff_events(d, ref).count() == 0
    assert {(r.id, r.kmer) for r in sequence.kmer_profile(d, 2).collect()} == {(2, "AB"), (3, "AB")}
    assert {r.position for r in sequence.position_entropy(d).collect()} == {0, 1}


def test_trim_gap_columns(spark):
    d = records(spark, [(1, "x", 1, "A--B-"), (2, "x", 1, "A-CB-"), (3, "y", 1, "-----")])
    got = {r.id: r.sequence for r in sequence.trim_gap_columns(d).collect()}
    assert got == {1: "A-B", 2: "ACB", 3: ""}


def test_medoid_against_all_pairs(spark):
    rows, d = random_records(spark, 80)
    got = {r.grp: (r.id, r.mean_distance) for r in pairs.medoid(d).collect()}
    for g in "xy":
        own = [(i, s) for i, gg, _, s in rows if gg == g]
        mean = {i: sum(sum(x != y for x, y in zip(s, t)) + abs(len(s) - len(t)) for _, t in own) / len(own) for i, s in own}
        best = min(mean, key=lambda i: (round(mean[i], 9), i))
        assert got[g][0] == best and got[g][1] == pytest.approx(mean[best])


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(5)
    baskets = {r: {rng.choice("abcdefg") for _ in range(rng.randint(1, 5))} for r in range(200)}
    baskets[999] = set("abcdefg")
    rows = [(r, i) for r, s in baskets.items() for i in s] + [(999, "a")] * 500
    d = spark.createDataFrame(rows, "r long, i string")
    got = {(x.a, x.b): (x.n_both, x.n_a, x.n_b) for x in pairs.cooccurrence(d, "r", "i").collect()}
    n = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    assert got == {p: (c, n[p[0]], n[p[1]]) for p, c in both.items()}


def test_npmi_window_limits_partners(spark):
    rows = [(1, 2000, 0, "A"), (1, 2000, 3, "B"), (1, 2000, 9, "C"), (2, 2000, 3, "B")]
    ev = spark.createDataFrame(rows, "id long, period int, position int, var_char string")
    got = {r.position: (r.n_neighbours, r.n_pairs, r.method) for r in pairs.npmi_score(ev, w=3).collect()}
    assert got == {0: (1, 1, "fallback"), 3: (1, 1, "fallback"), 9: (0, 0, "fallback")}
    for r in pairs.npmi_score(ev, w=6, min_pairs=1).collect():
        assert 0.0 <= r.score <= 1.0


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_close_pairs_are_complete(spark, limit):
    rng = random.Random(4)
    texts = ["".join(rng.choice("AC") for _ in range(n)) for n in (6, 6, 7, 9) for _ in range(40)]
    d = records(spark, [(i, "x", 1, t) for i, t in enumerate(texts)])
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want = set()
    for (s, i), (t, j) in combinations(first.items(), 2):
        differ = sum(x != y for x, y in zip(s, t))
        if len(s) == len(t) and differ <= limit:
            want.add((min(i, j), max(i, j), differ))
    assert {tuple(r) for r in pairs.close_pairs(d, limit).collect()} == want


@pytest.mark.parametrize("limit, pivots, cell_rows", [(0, 8, 1), (2, 8, 1), (2, 0, 1), (5, 3, 4), (5, 8, 1000), (40, 2, 1)])
def test_metric_pairs_are_complete(spark, limit, pivots, cell_rows):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACÜ") for _ in range(rng.choice([0, 1, 5, 6, 7, 12, 13, 30]))) for _ in range(90)]
    texts += [t[:-1] for t in texts[:20]] + texts[:10] + ["A" * 20_000, "A" * 20_001, None]
    rows = [(i, "x", 1, t) for i, t in enumerate(texts)] + [(3, "x", 1, texts[3]), (None, "x", 1, "AC")]
    first = {}
    for i, _, _, t in rows:
        if t is not None and i is not None:
            first[t] = min(i, first.get(t, i))
    want = set()
    for (s, i), (t, j) in combinations(first.items(), 2):
        differ = sum(x != y for x, y in zip(s, t)) + abs(len(s) - len(t))
        if differ <= limit:
            want.add((min(i, j), max(i, j), differ))
    got = [tuple(r) for r in metric.metric_pairs(records(spark, rows), limit, n_pivots=pivots, cell_rows=cell_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pivots_drop_candidates(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("AC") for _ in range(40)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, sequence string")
    n = [metric.candidate_pairs(metric.pivot_distances(d, texts[:k]), 2, 1 + k, 16).count() for k in (0, 8)]
    assert n[0] == 300 * 299 / 2 and n[1] < n[0] / 20


def test_texts_without_a_common_segment_are_no_candidates(spark):
    """Long texts of one length are about as far from any pivot; only near copies share a segment."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(300)]
    texts += [t[:50] + "NN" + t[52:] for t in texts[:7]]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, sequence string")
    assert {tuple(r) for r in metric.segment_pairs(d, 5).collect()} == {(i, 300 + i) for i in range(7)}
    assert {tuple(r) for r in metric.metric_pairs(d, 5).collect()} == {(i, 300 + i, 2) for i in range(7)}


def near_copies(n_groups, n_copies, length=600, seed=11):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(n_groups)]
    return list(dict.fromkeys(t[:i] + c + t[i + 1:] for t in texts for c in "NX" for i in rng.sample(range(length), n_copies)))


@pytest.mark.parametrize("chars", [2000, 20_000, 1 << 22])
def test_metric_pairs_of_many_buckets(spark, monkeypatch, chars):
    """A cluster that is larger than a bucket, and buckets of several clusters."""
    monkeypatch.setattr(metric, "BUCKET_CHARS", chars)
    texts = near_copies(1, 30) + near_copies(6, 4, 300) + [t[7:] for t in near_copies(2, 3, 299)]
    want = {(i, j, d) for (i, s), (j, t) in combinations(enumerate(texts), 2)
            if (d := sum(x != y for x, y in zip(s, t)) + abs(len(s) - len(t))) <= 5}
    got = [tuple(r) for r in metric.metric_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, sequence string"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1770


def test_documents_meet_in_all_buckets():
    key = np.array([5, 5, 5, 6, 6, 7, 8, 8], np.uint64)
    doc, bucket = np.arange(8), np.array([1, 2, 3, 1, 1, 1, 2, 1], np.int32)
    found = {t for step in metric._shared(key, doc, bucket) for t in zip(*(x.tolist() for x in step))}
    assert found == {(i, int(bucket[i]), int(bucket[j])) for i in range(8) for j in range(8) if i != j and key[i] == key[j]}
    alone = [x for step in metric._shared(key[[0, 1]], doc[[0, 1]], bucket[[0, 1]]) for x in zip(*(y.tolist() for y in step))]
    assert sorted(alone) == [(0, 1, 2), (1, 2, 1)]


def test_metric_pairs_keep_no_candidates(spark, monkeypatch):
    """What is stored on the way grows with the texts: none of it has a row a pair."""
    stored, written = [], metric.written

    def kept(df, name):
        out = written(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(metric, "written", kept)
    monkeypatch.setattr(metric, "materialize", lambda df: kept(df, "kept"))
    texts = near_copies(2, 40)
    pairs_ = metric.metric_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, sequence string"), 5)
    assert pairs_.count() == 2 * 80 * 79 / 2 and max(stored) <= len(texts) == 160


def test_diverse_selection_is_reproducible_and_spread(spark):
    rows = [(i, "x", 1, "AAAA") for i in range(20)] + [(50, "x", 1, "CCCC"), (51, "x", 1, "AACC")]
    got = [{r.id for r in pairs.diverse_select(records(spark, rows).repartition(p), "grp", 3).collect()} for p in (1, 8)]
    assert got[0] == got[1] and {50, 51} <= got[0] and len(got[0]) == 3


def test_landmark_map_places_equal_rows_together(spark):
    rows = [(i, "x", 1, "AAAA" if i % 2 else "CCCC") for i in range(30)]
    got = {(round(r.x, 6), round(r.y, 6)) for r in pairs.landmark_map(records(spark, rows), 10).collect()}
    assert len(got) == 2
    assert pairs.map_stress(pairs.landmark_map(records(spark, rows), 10)).first().stress == pytest.approx(0.0, abs=1e-6)


def test_fasta_round_trip(spark, tmp_path):
    rows = [("s1", 2001, "New York", "ACGT" * 40), ("s2", 2002, "Lima", "A"), ("s3", 2003, "Oslo", "")]
    d = spark.createDataFrame(rows, "id string, period int, place string, sequence string")
    io.write_fasta(d, str(tmp_path / "f"), ["id", "period", "place"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "f")).collect())
    assert max(map(len, text.split("\n"))) <= 70
    got = {(r.id, r.period, r.place, r.sequence) for r in io.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {("s1", 2001, "New_York", "ACGT" * 40), ("s2", 2002, "Lima", "A"), ("s3", 2003, "Oslo", "")}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    d = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "a int, b string")
    one = tuple(io.content_fingerprint(d).first())
    assert one == tuple(io.content_fingerprint(d.orderBy(F.desc("a")).repartition(7)).first())
    assert one != tuple(io.content_fingerprint(d.where("a <> 3")).first())


def test_overlay_replaces_only_inside_the_group(spark):
    base = spark.createDataFrame([(1, "x", 0), (2, "x", 0), (3, "y", 0)], "id int, g string, v int")
    patch = spark.createDataFrame([(2, "x", 9), (3, "y", 9)], "id int, g string, v int")
    got = sorted(tuple(r) for r in io.overlay(base, patch, ["id"], F.col("g") == "x").collect())
    assert got == [(1, "x", 0), (2, "x", 9), (3, "y", 0), (3, "y", 9)]


def test_ordinal_pairs_unordered_lookup(spark):
    dim = spark.createDataFrame([("a", 0), ("c", 1), ("b", 2)], "name string, ordinal int")
    ext = spark.createDataFrame([("c", "a", 1.5), ("b", "c", 2.0)], "a string, b string, distance double")
    got = {(r.a, r.b): (r.steps, r.distance) for r in joins.ordinal_pairs(dim, ext, 2).collect()}
    assert got == {("a", "c"): (1, 1.5), ("a", "b"): (2, None), ("c", "b"): (1, 2.0)}
    assert joins.ordinal_pairs(dim, ext, 1).count() == 2


def test_period_rate_never_exceeds_100(spark):
    d = records(spark, [(1, "x", 1, "AB"), (2, "x", 2, "AB"), (3, "x", 1, "BA"), (4, "x", 1, "AB")])
    ev = sequence.diff_events(d, sequence.modal_reference(d)).withColumn("in_region", F.lit(True))
    got = {r.period: (r.n_sequences, r.n_flagged, r.pct) for r in series.period_rate(ev, d, 1, 3).collect()}
    assert got[1][:2] == (3, 1) and got[1][2] == pytest.approx(100 / 3)
    assert got[2] == (1, 0, 0.0) and got[3] == (0, 0, 0.0)


def test_candidates_of_close_pairs_are_the_pairs(spark):
    words = ["".join(w) for n in (1, 3, 5) for w in product("ABC", repeat=n)]
    d = spark.createDataFrame(list(enumerate(words)), "id long, sequence string")
    want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words)
            if i < j and len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1}
    met = [(r.id_a, r.id_b) for r in pairs.segment_meetings(d, 1, "id", "sequence").collect()]
    assert len(met) == len(want) and set(met) == want


def test_orders_are_joined_once_for_the_selection(spark, tmp_path, monkeypatch):
    from driftengine.plans import sequences

    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double"
    order = "o_orderkey long, o_orderpriority string, o_orderdate timestamp, o_orderstatus string"
    spark.createDataFrame([(k, n, 1, 1, (k * n % 11) / 100) for k in range(12) for n in (1, 2, 3)], line).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "pq"[k % 2], datetime.datetime(2024, 1, 1), "F") for k in range(12)], order).write.parquet(
        f"{tmp_path}/orders.parquet")
    given, select = [], pairs.diverse_select

    def watched(df, *args):
        given.append(df._jdf.queryExecution().optimizedPlan().toString())
        return select(df, *args)

    monkeypatch.setattr(sequences.pairs, "diverse_select", watched)
    assert sequences.d23(spark, str(tmp_path)).count() == 10
    assert "Join" not in given[0] and "Relation" not in given[0]


def test_medoid_counts_symbols_in_tasks(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("every symbol becomes a row")

    rng = random.Random(4)
    rows = [(i % 50, rng.choice(["g", "h", None]), "".join(rng.choice("AC漢😀") for _ in range(rng.choice([0, 1, 4, 9, 30])))) for i in range(120)]
    rows += [(200, "g", None), (201, "empty", ""), (202, "empty", "")]
    d = spark.createDataFrame(rows, "id long, grp string, sequence string").repartition(5)
    want = {}
    for g in ("g", "h", "empty"):
        mine = [(i, s) for i, h, s in rows if h == g and s is not None]
        total, symbols = {}, sum(len(s) for _, s in mine)
        for i, s in mine:  # an id's rows are added up
            apart = sum(sum(x != y for x, y in zip(s, t)) + abs(len(s) - len(t)) for _, t in mine)
            total[i] = total.get(i, symbols) + apart - symbols
        best = min(total, key=lambda i: (total[i], i))
        want[g] = best, total[best] / len(mine)
    monkeypatch.setattr(pairs.F, "posexplode_outer", refuse)
    for block, texts, cells in ((512, 1 << 16, 1 << 21), (4, 3, 10)):
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(pairs, "CELLS", cells)
        got = {r.grp: (r.id, r.mean_distance) for r in pairs.medoid(d).collect()}
        assert {g: r[0] for g, r in got.items()} == {g: w[0] for g, w in want.items()}
        assert [got[g][1] for g in want] == pytest.approx([w[1] for w in want.values()])
