"""Sequence, pair and sampling operators over whole documents and whole order sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftengine.functions.columns import hamming
from driftengine.operators import metric, pairs, sampling, sequence, series, stats
from driftengine.plans.data import (
    DOCS,
    EV,
    FLAGGED,
    ORDS,
    PREDS,
    R,
    dist_sql,
    doc_records,
    flagged_events,
    modal_sql,
    order_events,
    order_records,
    predictions,
    regions,
    rounded,
    table,
)
from driftengine.plans.registry import query
from driftengine.scale import materialize


def doc_distances(spark: SparkSession, d: str) -> DataFrame:
    docs = doc_records(spark, d)
    return sequence.distance_to_reference(docs, sequence.modal_reference(docs))


DOC_DIST = f"{DOCS}, {modal_sql('docs')}, {dist_sql('docs')}"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of whole documents to the modal document of their language, per period,
    with the weighted rate of the language."""
    by_period = materialize(series.divergence_by_period(doc_distances(spark, d)))
    t, w = (F.col("period") + 1).cast("double"), F.col("sample_size").cast("double")
    rate = stats.rate_through_origin(by_period, t, F.col("mean_distance"), w, ["grp"])
    return rounded(by_period.join(rate, "grp").select(
        "grp", "period", "mean_distance", "std_distance", "sample_size", "rate"))


query("flagship_divergence", f"""WITH {DOC_DIST}, g AS (SELECT grp, period, avg(distance) AS mean_distance,
    coalesce(stddev_samp(distance), 0) AS std_distance, count(*) AS sample_size FROM dist GROUP BY 1, 2),
  f AS (SELECT grp, sum(sample_size * (period + 1) * mean_distance) / sum(sample_size * (period + 1) * (period + 1)) AS rate
    FROM g GROUP BY 1)
  SELECT grp, period, {R('mean_distance')}, {R('std_distance')}, sample_size, {R('rate')} FROM g JOIN f USING (grp)""")(flagship)


# --- sequences -----------------------------------------------------------------------------


@query("d1_hamming", f"""WITH {ORDS}, p AS (SELECT id, sequence, reverse(sequence) AS other, length(sequence) AS n FROM ords)
  SELECT id, {R("len(list_filter(list_zip(string_split(sequence, ''), string_split(other, '')), lambda x: x[1] <> x[2])) / n", 'share')},
    CAST(len(list_filter(list_zip(string_split(sequence, ''), string_split(other, '')), lambda x: x[1] <> x[2])) AS DOUBLE) AS mismatches,
    {R("(len(list_filter(list_zip(string_split(sequence, '')[1:2], string_split(other, '')[1:2]), lambda x: x[1] <> x[2])) + greatest(n - 2, 0)) / least(n, 2)", 'padded')}
  FROM p""")
def d1(spark, d):
    r = order_records(spark, d).withColumn("other", F.reverse("sequence"))
    s, o = F.col("sequence"), F.col("other")
    return rounded(r.select(
        "id", hamming(s, o).alias("share"), hamming(s, F.lower(o), normalize=False, ignore_case=True).alias("mismatches"),
        hamming(s, F.substring(o, 1, 2), pad=True).alias("padded")))


@query("d2_modal_reference", f"WITH {DOCS}, {modal_sql('docs')} SELECT * FROM refs")
def d2(spark, d):
    return sequence.modal_reference(doc_records(spark, d))


@query("d2_modal_reference_period", f"WITH {DOCS}, {modal_sql('docs', 'period <= 9')} SELECT * FROM refs")
def d2_period(spark, d):
    return sequence.modal_reference(doc_records(spark, d), where=F.col("period") <= 9)


@query("d3_distance_to_reference", f"WITH {DOC_DIST} SELECT id, grp, {R('distance')} FROM dist")
def d3(spark, d):
    return rounded(doc_distances(spark, d).select("id", "grp", "distance"))


@query("d4_lineage_filter", f"WITH {DOC_DIST} SELECT id, grp, period, {R('distance')} FROM dist WHERE distance < 800 AND period >= 5")
def d4(spark, d):
    return rounded(sequence.lineage_filter(doc_distances(spark, d), 800, 5).select("id", "grp", "period", "distance"))


@query("d5_diff_events", f"WITH {EV} SELECT * FROM ev")
def d5(spark, d):
    return order_events(spark, d)[2]


DOC_CHARS = f"""{DOCS}, {modal_sql('docs')}, dc AS (SELECT id, s.grp, unnest(range(0, length(sequence))) AS position,
    unnest(string_split(sequence, '')) AS symbol FROM docs s),
  rc AS (SELECT grp, ref_length, unnest(range(0, ref_length)) AS position, unnest(string_split(ref, '')) AS ref_char FROM refs)"""


@query("d5_diff_events_documents", f"""WITH {DOC_CHARS} SELECT grp, ref_char, symbol AS var_char, count(*) AS n,
    CAST(sum(position) AS BIGINT) AS sum_position FROM dc JOIN rc USING (grp, position) WHERE symbol <> ref_char GROUP BY ALL""")
def d5_documents(spark, d):
    docs = doc_records(spark, d)
    ev = sequence.diff_events(docs, sequence.modal_reference(docs))
    return ev.groupBy("grp", "ref_char", "var_char").agg(
        F.count(F.lit(1)).alias("n"), F.sum("position").alias("sum_position"))


@query("d6_position_rate", f"""WITH {DOC_CHARS}, e AS (SELECT grp, position, count(*) AS n FROM dc JOIN rc USING (grp, position)
    WHERE symbol <> ref_char GROUP BY ALL), t AS (SELECT grp, count(*) AS n_rows FROM docs GROUP BY 1)
  SELECT grp, CAST(position AS INTEGER) AS position, coalesce(n, 0) AS n, {R('coalesce(n, 0) / n_rows', 'rate')}
  FROM rc JOIN t USING (grp) LEFT JOIN e USING (grp, position)""")
def d6(spark, d):
    docs = doc_records(spark, d)
    return rounded(sequence.position_rate(docs, sequence.modal_reference(docs)))


@query("d7_position_entropy", f"""WITH {DOC_CHARS}, c AS (SELECT grp, position, symbol, count(*) AS n FROM dc GROUP BY ALL)
  SELECT grp, CAST(position AS INTEGER) AS position, CAST(sum(n) AS BIGINT) AS n_symbols, count(*) AS n_distinct,
    {R('greatest(0, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2))', 'entropy')} FROM c GROUP BY 1, 2""")
def d7(spark, d):
    return rounded(sequence.position_entropy(doc_records(spark, d)))


@query("d7_entropy_normalized", f"""WITH {ORDS}, c AS (SELECT grp, position, symbol, count(*) AS n FROM (SELECT grp,
    unnest(range(0, length(sequence))) AS position, unnest(string_split(sequence, '')) AS symbol FROM ords)
    WHERE symbol IN ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H') GROUP BY ALL)
  SELECT grp, CAST(position AS INTEGER) AS position, CAST(sum(n) AS BIGINT) AS n_symbols, count(*) AS n_distinct,
    {R('greatest(0, least(1, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(8)))', 'entropy')} FROM c GROUP BY 1, 2""")
def d7_normalized(spark, d):
    return rounded(sequence.position_entropy(order_records(spark, d), alphabet="ABCDEFGH", normalize_k=8))


@query("d8_kmer_profile", f"""WITH {ORDS}, k AS (SELECT id, length(sequence) - 1 AS t,
    substr(sequence, CAST(unnest(range(1, length(sequence))) AS BIGINT), 2) AS kmer FROM ords)
  SELECT id, kmer, count(*) AS n, {R('count(*) / any_value(t)', 'freq')} FROM k GROUP BY id, kmer""")
def d8(spark, d):
    return rounded(sequence.kmer_profile(order_records(spark, d), 2))


@query("d8_kmer_documents", f"""WITH {DOCS}, s AS (SELECT id, string_split(sequence, '') AS a, length(sequence) AS n FROM docs),
  k AS (SELECT id, n - 2 AS t, unnest(list_zip(a[1:n-2], a[2:n-1], a[3:n])) AS z FROM s WHERE n >= 3),
  f AS (SELECT id, z[1] || z[2] || z[3] AS kmer, count(*) AS n, count(*) / any_value(t) AS freq FROM k GROUP BY ALL)
  SELECT kmer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n, {R('sum(freq)', 'freq')} FROM f GROUP BY 1""")
def d8_documents(spark, d):
    return rounded(sequence.kmer_profile(doc_records(spark, d), 3).groupBy("kmer").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"), F.sum("freq").alias("freq")))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("d9_composition", f"""WITH {DOCS} SELECT id, {R("(length(sequence) - length(translate(sequence, 'aeiou', ''))) / length(sequence)", 'fraction')},
  {R('(' + ' + '.join(f"contains(sequence, '{c}')::INT" for c in LETTERS) + ') / 26', 'coverage')} FROM docs""")
def d9(spark, d):
    return rounded(sequence.composition(doc_records(spark, d), "aeiou", LETTERS).select("id", "fraction", "coverage"))


GAPPED = f"""{ORDS}, gap AS (SELECT id, grp, rpad(substr(sequence, 1, 2) || '-' || substr(sequence, 3), 24, '-') AS sequence FROM ords)"""


@query("d10_trim_gap_columns", f"""WITH {GAPPED}, c AS (SELECT id, grp, unnest(range(0, length(sequence))) AS position,
    unnest(string_split(sequence, '')) AS symbol FROM gap),
  keep AS (SELECT DISTINCT grp, position FROM c WHERE symbol <> '-')
  SELECT id, grp, string_agg(symbol, '' ORDER BY position) AS sequence FROM c JOIN keep USING (grp, position) GROUP BY id, grp""")
def d10(spark, d):
    gapped = F.rpad(F.concat(F.substring("sequence", 1, 2), F.lit("-"), F.expr("substring(sequence, 3)")), 24, "-")
    rows = order_records(spark, d).select("id", "grp", gapped.alias("sequence"))
    return sequence.trim_gap_columns(rows).select("id", "grp", "sequence")


@query("d11_variant_summary", f"""WITH {EV} SELECT grp, position, ref_char, var_char, count(*) AS frequency,
  min(period) AS first_period, max(period) AS last_period, count(DISTINCT period) AS n_periods,
  (list(id ORDER BY period, id))[1] AS first_id FROM ev GROUP BY ALL""")
def d11(spark, d):
    return sequence.variant_summary(order_events(spark, d)[2])


FREQ = f"""{EV}, sizes AS (SELECT grp, count(*) AS n_rows FROM ords GROUP BY 1),
  freq AS (SELECT grp, position, ref_char, var_char, count(*) AS count FROM ev GROUP BY ALL)"""


@query("d12_variant_frequency", f"""WITH {FREQ} SELECT freq.*, n_rows, {R('count / n_rows', 'frequency')} FROM freq JOIN sizes USING (grp)""")
def d12(spark, d):
    records, _, ev = order_events(spark, d)
    return rounded(sequence.variant_frequency(ev, records))


@query("d13_top_variants", f"""WITH {FREQ} SELECT * FROM freq ORDER BY count DESC, grp, position, ref_char, var_char LIMIT 10""")
def d13(spark, d):
    counts = order_events(spark, d)[2].groupBy(*sequence.VARIANT).agg(F.count(F.lit(1)).alias("count"))
    return sequence.top_variants(counts, 10)


TOP3 = f"""{FREQ}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp
  ORDER BY count DESC, grp, position, ref_char, var_char) AS rank FROM freq) WHERE rank <= 3)"""


@query("d13_top_variants_per_group", f"WITH {TOP3} SELECT grp, position, ref_char, var_char, count, CAST(rank AS INTEGER) AS rank FROM top")
def d13_group(spark, d):
    counts = order_events(spark, d)[2].groupBy(*sequence.VARIANT).agg(F.count(F.lit(1)).alias("count"))
    return sequence.top_variants(counts, 3, ["grp"])


@query("d14_variant_trend", f"""WITH {TOP3}, pr AS (SELECT grp, period, count(*) AS n_rows FROM ords GROUP BY 1, 2),
  e AS (SELECT grp, position, ref_char, var_char, period, count(*) AS n FROM ev GROUP BY ALL)
  SELECT grp, position, ref_char, var_char, period, pr.n_rows, coalesce(n, 0) AS n, {R('coalesce(n, 0) / pr.n_rows', 'frequency')}
  FROM top JOIN pr USING (grp) LEFT JOIN e USING (grp, position, ref_char, var_char, period)""")
def d14(spark, d):
    records, _, ev = order_events(spark, d)
    counts = ev.groupBy(*sequence.VARIANT).agg(F.count(F.lit(1)).alias("count"))
    return rounded(sequence.variant_trend(ev, records, sequence.top_variants(counts, 3, ["grp"])))


@query("d15_flag_region", f"WITH {FLAGGED} SELECT id, position, in_region FROM fev")
def d15(spark, d):
    return flagged_events(spark, d)[2].select("id", "position", "in_region")


@query("d16_region_enrichment", f"""WITH {FLAGGED}, c AS (SELECT grp, count(*) FILTER (WHERE in_region) AS in_events,
    count(*) FILTER (WHERE NOT in_region) AS out_events FROM fev GROUP BY 1),
  b AS (SELECT grp, ref_length, n_rows, (SELECT count(*) FROM (VALUES (0), (2), (3)) p(x) WHERE x < ref_length) AS n_in,
    coalesce(in_events, 0) AS in_events, coalesce(out_events, 0) AS out_events
    FROM refs JOIN (SELECT grp, count(*) AS n_rows FROM ords GROUP BY 1) USING (grp) LEFT JOIN c USING (grp)),
  f AS (SELECT *, in_events / (n_rows * n_in) AS density_in,
    CASE WHEN ref_length > n_in THEN out_events / (n_rows * (ref_length - n_in)) ELSE 0e0 END AS density_out,
    (in_events + out_events) * n_in / ref_length AS e_in, (in_events + out_events) * (ref_length - n_in) / ref_length AS e_out FROM b)
  SELECT grp, ref_length, n_rows, n_in, in_events, out_events, {R('density_in')}, {R('density_out')},
    {R('CASE WHEN density_out > 0 THEN density_in / density_out ELSE 1e0 END', 'enrichment')},
    {R('CASE WHEN e_in > 0 AND e_out > 0 THEN (in_events - e_in) ** 2 / e_in + (out_events - e_out) ** 2 / e_out ELSE 0e0 END', 'chi2')} FROM f""")
def d16(spark, d):
    records, ref, ev = order_events(spark, d)
    return rounded(sequence.region_enrichment(ev, records, ref, regions(spark), with_p=False))


@query("d17_flag_share", f"""WITH {FLAGGED} SELECT grp, var_char, count(*) AS n, count(*) FILTER (WHERE in_region) AS n_flagged,
  {R('count(*) FILTER (WHERE in_region) / count(*)', 'share')}, count(*) FILTER (WHERE in_region) / count(*) >= 75e-2 AS above
  FROM fev GROUP BY 1, 2 HAVING count(*) >= 10""")
def d17(spark, d):
    return rounded(sequence.flag_share(flagged_events(spark, d)[2], ["grp", "var_char"], "in_region", 10, 0.75))


BASKET = """inc AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
  tot AS (SELECT count(DISTINCT l_orderkey) AS n_records FROM inc),
  fr AS (SELECT p_brand, count(*) AS n FROM inc GROUP BY 1 HAVING count(*) >= (SELECT greatest(5, floor(n_records * 5e-2)) FROM tot)),
  pr AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n_both FROM inc x JOIN inc y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand
    WHERE x.p_brand IN (SELECT p_brand FROM fr) AND y.p_brand IN (SELECT p_brand FROM fr) GROUP BY 1, 2)"""


def baskets(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "p_brand")


@query("d18_cooccurrence", f"""WITH {BASKET} SELECT a, b, n_both, fa.n AS n_a, fb.n AS n_b, n_records,
  {R('n_both * (n_records - fa.n - fb.n + n_both) / CAST((fa.n - n_both) * (fb.n - n_both) AS DOUBLE)', 'odds_ratio')}
  FROM pr JOIN fr fa ON fa.p_brand = a JOIN fr fb ON fb.p_brand = b, tot""")
def d18(spark, d):
    return rounded(pairs.cooccurrence(baskets(spark, d), "l_orderkey", "p_brand", with_p=False))


def _log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


#: Upper tail of the hypergeometric law, term by term.
TAIL = (f"exp({_log_choose('n_b', 'h')} + {_log_choose('(n_records - n_b)', '(n_a - h)')} - "
        f"{_log_choose('n_records', 'n_a')})")


@query("d18_cooccurrence_fisher", f"""WITH {BASKET}, t AS (SELECT a, b, n_both, fa.n AS n_a, fb.n AS n_b, n_records
    FROM pr JOIN fr fa ON fa.p_brand = a JOIN fr fb ON fb.p_brand = b, tot),
  s AS (SELECT *, unnest(range(n_both, least(n_a, n_b) + 1)) AS h FROM t)
  SELECT a, b, n_both, n_a, n_b, n_records,
    {R('n_both * (n_records - n_a - n_b + n_both) / CAST((n_a - n_both) * (n_b - n_both) AS DOUBLE)', 'odds_ratio')},
    {R(f'least(sum({TAIL}), 1)', 'p')} FROM s GROUP BY ALL""")
def d18_fisher(spark, d):
    return rounded(pairs.cooccurrence(baskets(spark, d), "l_orderkey", "p_brand"))


@query("d19_npmi_score", f"""WITH {EV}, e AS (SELECT DISTINCT period, id, position, var_char FROM ev),
  nr AS (SELECT period, count(DISTINCT id) AS n FROM e GROUP BY 1),
  s AS (SELECT period, position, var_char, count(*) AS c FROM e GROUP BY ALL),
  co AS (SELECT x.period, x.position, x.var_char, y.position AS pj, y.var_char AS vj, count(*) AS cij FROM e x JOIN e y
    ON x.period = y.period AND x.id = y.id AND x.position <> y.position AND abs(x.position - y.position) <= 20 GROUP BY ALL),
  sc AS (SELECT co.*, n, a.c AS ci, b.c AS cj,
    ln((cij / n) / ((a.c / n) * (b.c / n) + 1e-10) + 1e-10) / (-ln(cij / n + 1e-10)) AS v
    FROM co JOIN nr USING (period) JOIN s a ON a.period = co.period AND a.position = co.position AND a.var_char = co.var_char
    JOIN s b ON b.period = co.period AND b.position = co.pj AND b.var_char = co.vj),
  best AS (SELECT period, position, var_char, avg(v) AS m FROM (SELECT *, row_number() OVER (PARTITION BY period, position, var_char
    ORDER BY v DESC, pj, vj) AS rk FROM sc) WHERE rk <= 3 GROUP BY ALL),
  tt AS (SELECT period, position, var_char, CAST(sum(cij) AS BIGINT) AS n_pairs, count(*) AS n_neighbours FROM co GROUP BY ALL),
  j AS (SELECT s.*, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_neighbours, 0) AS n_neighbours, m FROM s
    LEFT JOIN tt USING (period, position, var_char) LEFT JOIN best USING (period, position, var_char))
  SELECT period, position, var_char, c AS n_records, n_pairs, n_neighbours, CASE WHEN n_pairs >= 50 THEN 'npmi' ELSE 'fallback' END AS method,
    {R('CASE WHEN n_pairs >= 50 THEN least(greatest(m, 0), 1) ELSE least(n_neighbours / 20, 1) END', 'score')} FROM j""")
def d19(spark, d):
    return rounded(pairs.npmi_score(order_events(spark, d)[2]))


@query("d20_close_pairs", f"""WITH {ORDS}, r AS (SELECT sequence, min(id) AS id FROM ords GROUP BY 1),
  p AS (SELECT x.id AS id_a, y.id AS id_b, len(list_filter(list_zip(string_split(x.sequence, ''), string_split(y.sequence, '')),
    lambda z: z[1] <> z[2])) AS distance FROM r x JOIN r y ON length(x.sequence) = length(y.sequence) AND x.id < y.id)
  SELECT id_a, id_b, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= 1""")
def d20(spark, d):
    return pairs.close_pairs(order_records(spark, d), 1)


#: Differing positions that documents of a pair may have.
DOC_LIMIT = 40


@query("d20_metric_pairs", f"""WITH {DOCS}, r AS MATERIALIZED (SELECT min(id) AS id, length(sequence) AS n, string_split(sequence, '') AS c
    FROM docs WHERE sequence IS NOT NULL GROUP BY sequence),
  p AS (SELECT x.id AS id_a, y.id AS id_b, abs(x.n - y.n) + len(list_filter(list_zip(x.c[1:least(x.n, y.n)], y.c[1:least(x.n, y.n)]),
    lambda z: z[1] <> z[2])) AS distance FROM r x JOIN r y ON x.n BETWEEN y.n - {DOC_LIMIT} AND y.n + {DOC_LIMIT} AND x.id < y.id)
  SELECT id_a, id_b, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= {DOC_LIMIT}""")
def d20_documents(spark, d):
    return metric.metric_pairs(doc_records(spark, d), DOC_LIMIT)


@query("d21_medoid", f"""WITH {ORDS}, c AS (SELECT id, grp, unnest(range(0, length(sequence))) AS position,
    unnest(string_split(sequence, '')) AS symbol FROM ords),
  n AS (SELECT grp, position, symbol, count(*) AS c FROM c GROUP BY ALL), l AS (SELECT grp, position, count(*) AS l FROM c GROUP BY ALL),
  s AS (SELECT grp, count(*) AS n_rows, sum(length(sequence)) AS t FROM ords GROUP BY 1),
  v AS (SELECT c.id, c.grp, sum(s.n_rows - n.c - l.l) AS v, any_value(s.t) AS t, any_value(s.n_rows) AS n_rows FROM c JOIN n USING (grp, position, symbol) JOIN l USING (grp, position)
    JOIN s USING (grp) GROUP BY 1, 2)
  SELECT grp, id, {R('CAST((t + v) AS DOUBLE) / n_rows', 'mean_distance')} FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v, id) AS rk FROM v) WHERE rk = 1""")
def d21(spark, d):
    return rounded(pairs.medoid(materialize(order_records(spark, d))))


@query("d22_median_length_reference", f"""WITH {DOCS}, m AS (SELECT grp, median(length(sequence)) AS median_length FROM docs GROUP BY 1)
  SELECT grp, {R('median_length')}, id, CAST(len AS INTEGER) AS length FROM (SELECT grp, median_length, id, length(sequence) AS len,
    row_number() OVER (PARTITION BY grp ORDER BY abs(length(sequence) - median_length), id) AS rk FROM docs JOIN m USING (grp)) WHERE rk = 1""")
def d22(spark, d):
    return rounded(sequence.median_length_reference(doc_records(spark, d)))


def _farthest_sql(quota: int) -> str:
    """CTEs p1 .. p<quota>: all picks after each round of the farthest-point selection on ``ords``."""
    dist = """list_min(list_transform(p.picks, lambda q: CASE WHEN least(length(o.sequence), length(q)) = 0
      THEN CAST(length(o.sequence) <> length(q) AS INTEGER) * 1e0 ELSE
      len(list_filter(list_zip(string_split(o.sequence, '')[1:least(length(o.sequence), length(q))],
        string_split(q, '')[1:least(length(o.sequence), length(q))]), lambda x: x[1] <> x[2]))
      / least(length(o.sequence), length(q)) END))"""
    rounds = [f"""p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT grp, id, sequence, {n} FROM (
      SELECT o.grp, o.id, o.sequence, row_number() OVER (PARTITION BY o.grp ORDER BY {dist} DESC, o.id) AS rn
      FROM ords o JOIN (SELECT grp, list(sequence) AS picks, list(id) AS ids FROM p{n - 1} GROUP BY 1) p USING (grp)
      WHERE NOT list_contains(p.ids, o.id)) WHERE rn = 1)""" for n in range(2, quota + 1)]
    return ",\n  ".join(rounds)


@query("d23_diverse_select", f"""WITH {ORDS}, c AS (SELECT id, grp, unnest(range(0, length(sequence))) AS position,
    unnest(string_split(sequence, '')) AS symbol FROM ords),
  n AS (SELECT grp, position, symbol, count(*) AS c FROM c GROUP BY ALL), l AS (SELECT grp, position, count(*) AS l FROM c GROUP BY ALL),
  s AS (SELECT grp, count(*) AS n_rows FROM ords GROUP BY 1),
  v AS (SELECT c.id, c.grp, sum(s.n_rows - n.c - l.l) AS v FROM c JOIN n USING (grp, position, symbol)
    JOIN l USING (grp, position) JOIN s USING (grp) GROUP BY 1, 2),
  p1 AS (SELECT v.grp, v.id, sequence, 1 AS pick FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v, id) AS rn FROM v) v
    JOIN ords ON ords.id = v.id WHERE rn = 1),
  {_farthest_sql(5)} SELECT id, grp, pick FROM p5""")
def d23(spark, d):
    # Read in every pass of the selection: the joins are made once.
    orders = materialize(order_records(spark, d).select("id", "grp", "sequence"))
    return pairs.diverse_select(orders, "grp", 5).select("id", "grp", "pick")


def _running_minima_sql(quota: int) -> str:
    """CTEs of the farthest-point selection on ``r`` (grp, id, c = symbols, first pick in p1): after each
    pick every row keeps its distance to the nearest one."""
    to = lambda q: (f"len(list_filter(list_zip(r.c[1:least(len(r.c), len({q}.c))], {q}.c[1:least(len(r.c), len({q}.c))]), "  # noqa: E731
                    f"lambda z: z[1] <> z[2])) / least(len(r.c), len({q}.c))")
    ctes = [f"m1 AS MATERIALIZED (SELECT r.grp, r.id, {to('p')} AS d FROM r JOIN p1 p USING (grp) WHERE r.id <> p.id)"]
    for n in range(2, quota + 1):
        ctes.append(f"""p{n} AS MATERIALIZED (SELECT r.grp, r.id, r.c FROM r JOIN (SELECT grp, id FROM (
      SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY d DESC, id) AS rn FROM m{n - 1}) WHERE rn = 1) USING (grp, id))""")
        ctes.append(f"""m{n} AS MATERIALIZED (SELECT r.grp, r.id, least(m.d, {to('p')}) AS d FROM m{n - 1} m JOIN r USING (grp, id)
      JOIN p{n} p USING (grp) WHERE r.id <> p.id)""")
    return ",\n  ".join(ctes)


DOC_PICKS = 10


@query("d23_diverse_documents", f"""WITH {DOCS}, r AS MATERIALIZED (SELECT grp, id, string_split(sequence, '') AS c FROM docs WHERE sequence IS NOT NULL),
  x AS (SELECT id, grp, unnest(range(0, len(c))) AS position, unnest(c) AS symbol FROM r),
  n AS (SELECT grp, position, symbol, count(*) AS c FROM x GROUP BY ALL), l AS (SELECT grp, position, count(*) AS l FROM x GROUP BY ALL),
  s AS (SELECT grp, count(*) AS n_rows FROM r GROUP BY 1),
  v AS (SELECT x.id, x.grp, sum(s.n_rows - n.c - l.l) AS v FROM x JOIN n USING (grp, position, symbol) JOIN l USING (grp, position) JOIN s USING (grp) GROUP BY 1, 2),
  p1 AS MATERIALIZED (SELECT r.grp, r.id, r.c FROM r JOIN (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v, id) AS rn FROM v) b USING (grp, id) WHERE rn = 1),
  {_running_minima_sql(DOC_PICKS)}
  SELECT grp, id, CAST(pick AS INTEGER) AS pick FROM ({' UNION ALL '.join(f'SELECT grp, id, {n} AS pick FROM p{n}' for n in range(1, DOC_PICKS + 1))})""")
def d23_documents(spark, d):
    return pairs.diverse_select(doc_records(spark, d), "grp", DOC_PICKS).select("id", "grp", "pick")


@query("d24_landmark_map")
def d24(spark, d):
    return rounded(pairs.landmark_map(doc_records(spark, d)).select("id", "grp", "x", "y", "err2", "d2"))


@query("d24_map_stress")
def d24_stress(spark, d):
    return rounded(pairs.map_stress(pairs.landmark_map(doc_records(spark, d)), ["grp"]))


@query("d25_to_sequence", """SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS sequence
  FROM events GROUP BY 1""")
def d25(spark, d):
    ev = table(spark, d, "events").withColumn("symbol", F.substring("event_type", 1, 1))
    return sequence.to_sequence(ev, ["user_id"], ["ts", "event_id"], "symbol")


@query("d25_to_positions", """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position,
  substr(event_type, 1, 1) AS symbol FROM events""")
def d25_positions(spark, d):
    ev = table(spark, d, "events").withColumn("symbol", F.substring("event_type", 1, 1))
    ev = ev.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return sequence.to_positions(ev, ["user_id"], "micros", "symbol", ["event_id"])


# --- sampling and splits -------------------------------------------------------------------

HASHED = f"""{PREDS}, h AS (SELECT *, md5(id || ':42') AS h FROM preds)"""


@query("e1_sample_even", f"""WITH {HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY h, id) AS rk FROM h)
  SELECT id, period FROM r WHERE rk <= greatest(1, 500 // (SELECT count(DISTINCT period) FROM preds))""")
def e1(spark, d):
    return sampling.sample_even(predictions(spark, d), "period", 500).select("id", "period")


@query("e2_sample_proportional", f"""WITH {HASHED}, s AS (SELECT period, count(*) AS c FROM preds GROUP BY 1),
  a AS (SELECT *, CAST(greatest(1, floor(c / (SELECT CAST(sum(c) AS BIGINT) FROM s) * 777)) AS BIGINT) AS a FROM s),
  q AS (SELECT *, a + CASE WHEN row_number() OVER (ORDER BY c DESC, period) <= 777 - (SELECT sum(a) FROM a) THEN 1 ELSE 0 END AS quota FROM a),
  r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY h, id) AS rk FROM h)
  SELECT id, period FROM r JOIN q USING (period) WHERE rk <= quota""")
def e2(spark, d):
    return sampling.sample_proportional(predictions(spark, d), "period", 777).select("id", "period")


@query("e3_sample_boosted", f"""WITH {HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY h, id) AS rk FROM h),
  p AS (SELECT id, period, h FROM r WHERE rk <= CASE WHEN period = 1997 THEN 300 ELSE
    300 // (SELECT count(DISTINCT period) - 1 FROM preds) END),
  x AS (SELECT id, period, row_number() OVER (ORDER BY h, id) AS rk FROM h WHERE id NOT IN (SELECT id FROM p))
  SELECT id, period FROM p UNION ALL SELECT id, period FROM x WHERE rk <= 600 - (SELECT count(*) FROM p)""")
def e3(spark, d):
    return sampling.sample_boosted(predictions(spark, d), "period", 1997, 0.5, 600).select("id", "period")


@query("e4_balance", f"""WITH {HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS rk FROM h)
  SELECT id, label FROM r WHERE rk <= least(1000, (SELECT min(c) FROM (SELECT count(*) AS c FROM preds GROUP BY label)))""")
def e4(spark, d):
    return sampling.balance(predictions(spark, d), "label", 1000).select("id", "label")


@query("e5_split", f"""WITH {HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS rk,
    count(*) OVER (PARTITION BY label) AS n FROM h)
  SELECT id, label, CASE WHEN rk <= floor(6e-1 * n) THEN 'train' WHEN rk <= floor(8e-1 * n) THEN 'validation' ELSE 'test' END AS part FROM r""")
def e5(spark, d):
    return sampling.split(predictions(spark, d), "label").select("id", "label", "part")


@query("e6_temporal_folds", f"""WITH {PREDS}, f(fold, train_max, test_min, test_max) AS (VALUES ('one', 1997, 1997, 1999),
    ('two', 1999, 1999, 2002), ('empty', 1980, 1980, 1990)),
  j AS (SELECT fold, id, CASE WHEN period < train_max THEN 'train' ELSE 'test' END AS role FROM preds JOIN f
    ON period < train_max OR (period >= test_min AND period < test_max)),
  ok AS (SELECT fold FROM j GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'train') >= 50 AND count(*) FILTER (WHERE role = 'test') >= 20)
  SELECT * FROM j WHERE fold IN (SELECT fold FROM ok)""")
def e6(spark, d):
    folds = spark.createDataFrame(
        [("one", 1997, 1997, 1999), ("two", 1999, 1999, 2002), ("empty", 1980, 1980, 1990)],
        "fold string, train_max int, test_min int, test_max int")
    return sampling.temporal_folds(predictions(spark, d), folds).select("fold", "id", "role")


@query("e7_expanding_folds", f"""WITH {PREDS}, p AS (SELECT period, count(*) AS n_test, count(*) FILTER (WHERE label = 1) AS pos_test FROM preds GROUP BY 1),
  q AS (SELECT *, CAST(coalesce(sum(n_test) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train FROM p)
  SELECT *, CASE WHEN n_test < 30 OR n_train = 0 THEN 'insufficient_data' WHEN pos_test = 0 OR pos_test = n_test THEN 'single_class' ELSE '' END AS note FROM q""")
def e7(spark, d):
    return sampling.expanding_folds(predictions(spark, d))


@query("e8_group_holdout", f"""WITH {EV} SELECT grp, position, ref_char, var_char, count(*) AS n, bool_or(place = 'P') AS held_out
  FROM ev JOIN (SELECT id, place FROM ords) USING (id) GROUP BY ALL""")
def e8(spark, d):
    records, ref, _ = order_events(spark, d)
    ev = sequence.diff_events(records, ref, keep=("id", "grp", "place"))
    return sampling.group_holdout(ev, "place", ["P"], sequence.VARIANT)


@query("e9_kfold", f"""WITH {HASHED} SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, id) - 1) % 5 AS INTEGER) AS fold FROM h""")
def e9(spark, d):
    return sampling.kfold(predictions(spark, d), 5, "label").select("id", "label", "fold")


@query("e10_leakage_audit", f"""WITH {PREDS} SELECT count(*) AS n, count(*) FILTER (WHERE period <= 1996) AS n_before,
  {R('count(*) FILTER (WHERE period <= 1996) / count(*)', 'share')},
  CASE WHEN count(*) FILTER (WHERE period <= 1996) > 0 THEN 'LEAKAGE' ELSE 'OK' END AS verdict FROM preds""")
def e10(spark, d):
    return rounded(sampling.leakage_audit(predictions(spark, d), 1996))
