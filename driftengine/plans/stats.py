"""Statistics, period series and forecasts over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftengine.operators import sequence, series, stats
from driftengine.plans.data import (
    DAYS,
    EV,
    FLAGGED,
    MONTHS,
    PREDS,
    R,
    day_metrics,
    doc_records,
    flagged_events,
    month_series,
    order_events,
    predictions,
    rounded,
    table,
)
from driftengine.plans.registry import query
from driftengine.plans.sequences import DOC_DIST, doc_distances

# --- statistics ----------------------------------------------------------------------------


@query("f1_rate_through_origin", f"""WITH {MONTHS} SELECT grp, {R('sum(n * period * mean_price) / sum(n * period * period)', 'rate')}
  FROM months WHERE period >= 1 GROUP BY 1""")
def f1(spark, d):
    m = month_series(spark, d).where("period >= 1")
    return rounded(stats.rate_through_origin(
        m, F.col("period").cast("double"), F.col("mean_price"), F.col("n").cast("double"), ["grp"]))


@query("f2_linear_trend", f"""WITH {MONTHS} SELECT grp, {R('regr_slope(mean_price, period)', 'slope')},
  {R('regr_intercept(mean_price, period)', 'intercept')}, {R('regr_r2(mean_price, period)', 'r2')},
  CAST(regr_count(mean_price, period) AS BIGINT) AS n FROM months GROUP BY 1""")
def f2(spark, d):
    return rounded(stats.linear_trend(month_series(spark, d), "period", "mean_price", ["grp"], with_p=False))


@query("f2_linear_trend_p")
def f2_p(spark, d):
    return rounded(stats.linear_trend(month_series(spark, d), "period", "mean_price", ["grp"]))


@query("f3_endpoint_rate", f"""WITH {MONTHS} SELECT grp, {R('arg_min(mean_price, period)', 'first')}, {R('arg_max(mean_price, period)', 'last')},
  max(period) - min(period) AS span, {R('(arg_max(mean_price, period) - arg_min(mean_price, period)) / (max(period) - min(period))', 'rate')}
  FROM months GROUP BY 1""")
def f3(spark, d):
    return rounded(stats.endpoint_rate(month_series(spark, d), "period", "mean_price", ["grp"]))


@query("f4_compare_to", f"""SELECT l_returnflag, {R('avg(l_quantity)', 'q')}, {R('(avg(l_quantity) - 25) / 25 * 100', 'pct_diff')},
  CASE WHEN abs((avg(l_quantity) - 25) / 25 * 100) <= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem GROUP BY 1""")
def f4(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q"))
    return rounded(stats.compare_to(q, "q", 25.0, 2.0))


@query("f5_trend_class", f"""WITH {MONTHS}, b AS (SELECT grp, CAST((period - 1) // 12 AS INTEGER) AS band, period, mean_price / 1000 AS y FROM months),
  s AS (SELECT grp, band, regr_slope(y, period) AS slope, regr_intercept(y, period) AS intercept, regr_r2(y, period) AS r2,
    CAST(regr_count(y, period) AS BIGINT) AS n FROM b GROUP BY 1, 2)
  SELECT grp, band, {R('slope')}, {R('intercept')}, {R('r2')}, n, CASE WHEN n < 2 OR slope IS NULL THEN 'single data point'
    WHEN abs(slope) < 3e-1 THEN 'plateau' ELSE CASE WHEN abs(slope) > 15e-1 THEN 'rapid' ELSE 'steady' END || ' ' ||
    CASE WHEN slope > 0 THEN 'increase' ELSE 'decrease' END END AS trend FROM s""")
def f5(spark, d):
    m = month_series(spark, d).withColumn("band", F.floor((F.col("period") - 1) / 12).cast("int")).withColumn(
        "y", F.col("mean_price") / 1000)
    return rounded(stats.trend_class(m, "period", "y", ["grp", "band"]))


@query("f6_chi2_gof", f"""WITH o AS (SELECT event_type, user_id % 7 AS cell, count(*) AS obs FROM events GROUP BY 1, 2),
  e AS (SELECT *, sum(obs) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type) AS expd FROM o)
  SELECT event_type, {R('sum((obs - expd) * (obs - expd) / expd)', 'chi2')}, count(*) - 1 AS dof FROM e GROUP BY 1""")
def f6(spark, d):
    o = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("cell")).agg(
        F.count(F.lit(1)).alias("obs"))
    mean = o.groupBy("event_type").agg(F.avg("obs").alias("expd"))
    return rounded(stats.chi2_gof(o.join(mean, "event_type"), "obs", "expd", ["event_type"], with_p=False))


@query("f7_chi2_contingency", f"""WITH c AS (SELECT lang, source, count(*) AS o FROM documents GROUP BY 1, 2),
  r AS (SELECT lang, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT source, sum(o) AS k FROM c GROUP BY 1),
  x AS (SELECT CAST(sum(o) AS BIGINT) AS n, sum(CAST(o AS DOUBLE) * o / (CAST(r AS DOUBLE) * k)) AS s,
    count(DISTINCT lang) AS nr, count(DISTINCT source) AS nc FROM c JOIN r USING (lang) JOIN k USING (source))
  SELECT n, {R('n * (s - 1)', 'chi2')}, (nr - 1) * (nc - 1) AS dof, {R('sqrt(n * (s - 1) / (n * (least(nr, nc) - 1)))', 'cramers_v')} FROM x""")
def f7(spark, d):
    return rounded(stats.chi2_contingency(table(spark, d, "documents"), "lang", "source", with_p=False))


@query("f7_chi2_2x2", f"""WITH t AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) AS a,
    count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity <= 25) AS b, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity > 25) AS c,
    count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity <= 25) AS d FROM lineitem GROUP BY 1),
  u AS (SELECT *, CAST(a + b + c + d AS DOUBLE) AS n, greatest(abs(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c) - (a + b + c + d) / 2, 0) AS gap FROM t),
  v AS (SELECT *, n * gap * gap / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS x FROM u)
  SELECT l_linestatus, a, b, c, d, {R('x', 'chi2')}, {R('sqrt(x / n)', 'cramers_v')}, {R('(a / (a + b)) / (c / (c + d))', 'enrichment')} FROM v""")
def f7_2x2(spark, d):
    rows = table(spark, d, "lineitem")
    return rounded(stats.chi2_2x2(
        rows, F.col("l_returnflag") == "R", F.col("l_quantity") > 25, ["l_linestatus"], correction=True, with_p=False))


TTEST = """SELECT {key} count(v) FILTER (WHERE f) AS n1, count(v) FILTER (WHERE NOT f) AS n2, avg(v) FILTER (WHERE f) AS m1,
  avg(v) FILTER (WHERE NOT f) AS m2, var_samp(v) FILTER (WHERE f) AS v1, var_samp(v) FILTER (WHERE NOT f) AS v2 FROM src {group}"""


@query("f8_t_test", f"""WITH src AS (SELECT event_type, value AS v, day(ts) < 15 AS f FROM events),
  t AS ({TTEST.format(key='event_type,', group='GROUP BY 1')}),
  s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM t)
  SELECT event_type, n1, n2, {R('m1', 'mean1')}, {R('m2', 'mean2')}, {R('(m1 - m2) / sd', 'cohens_d')},
    {R('(m1 - m2) / (sd * sqrt(1e0 / n1 + 1e0 / n2))', 't')} FROM s""")
def f8(spark, d):
    return rounded(stats.t_test(table(spark, d, "events"), "value", F.dayofmonth("ts") < 15, ["event_type"], with_p=False))


@query("f8_one_sample_t", f"""SELECT event_type, count(value) AS n, {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'sd')},
  {R('(avg(value) - 50) / (stddev_samp(value) / sqrt(count(value)))', 't')} FROM events GROUP BY 1""")
def f8_one(spark, d):
    return rounded(stats.one_sample_t(table(spark, d, "events"), "value", 50.0, ["event_type"], with_p=False))


_LOG_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query("f9_fisher_p", f"""WITH i AS (SELECT DISTINCT l_orderkey AS r, p_brand AS x FROM lineitem JOIN part ON p_partkey = l_partkey),
  nr AS (SELECT count(DISTINCT r) AS n FROM i), c AS (SELECT x, count(*) AS n FROM i GROUP BY 1),
  k AS (SELECT c.* FROM c, nr WHERE c.n >= greatest(5, floor(nr.n * 0.05))),
  t AS (SELECT p.x AS a, q.x AS b, count(*) AS n_both FROM i p JOIN i q ON p.r = q.r AND p.x < q.x JOIN k ka ON ka.x = p.x JOIN k kb ON kb.x = q.x GROUP BY 1, 2),
  u AS (SELECT t.a, t.b, n_both, kb.n - n_both AS only_b, ka.n - n_both AS only_a, nr.n - ka.n - kb.n + n_both AS neither
    FROM t JOIN k ka ON ka.x = t.a JOIN k kb ON kb.x = t.b, nr),
  s AS (SELECT *, unnest(range(n_both, n_both + least(only_a, only_b) + 1)) AS h FROM u)
  SELECT a, b, n_both, only_b, only_a, neither, {R("least(sum(exp(" + _LOG_CHOOSE.format('(n_both + only_b)', 'h') + " + "
    + _LOG_CHOOSE.format('(only_a + neither)', '(n_both + only_a - h)') + " - "
    + _LOG_CHOOSE.format('(n_both + only_a + only_b + neither)', '(n_both + only_a)') + ")), 1)", 'p')} FROM s GROUP BY ALL""")
def f9(spark, d):
    from driftengine.operators.pairs import cooccurrence
    from driftengine.plans.sequences import baskets

    t = cooccurrence(baskets(spark, d), "l_orderkey", "p_brand", with_p=False)
    t = t.select("a", "b", "n_both", (F.col("n_b") - F.col("n_both")).alias("only_b"),
                 (F.col("n_a") - F.col("n_both")).alias("only_a"),
                 (F.col("n_records") - F.col("n_a") - F.col("n_b") + F.col("n_both")).alias("neither"))
    return rounded(stats.fisher_p(t, "n_both", "only_b", "only_a", "neither"))


@query("f10_mann_whitney", f"""WITH r AS (SELECT value, day(ts) < 15 AS f, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2e0 AS rk FROM events),
  t AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT count(*) AS n FROM events GROUP BY value)),
  u AS (SELECT count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2,
    sum(rk) FILTER (WHERE f) - CAST(count(*) FILTER (WHERE f) AS DOUBLE) * (count(*) FILTER (WHERE f) + 1) / 2 AS u FROM r)
  SELECT n1, n2, {R('u')}, {R('2 * u / (CAST(n1 AS DOUBLE) * n2) - 1', 'rank_biserial')},
    {R('(u - CAST(n1 AS DOUBLE) * n2 / 2 - 5e-1) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))))', 'z')} FROM u, t""")
def f10(spark, d):
    return rounded(stats.mann_whitney(table(spark, d, "events"), "value", F.dayofmonth("ts") < 15, with_p=False))


@query("f11_agreement", f"""WITH b AS (SELECT l_quantity AS a, l_extendedprice / 2000 AS b FROM lineitem),
  r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra,
    rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM b)
  SELECT count(*) AS n, {R('corr(a, b)', 'pearson')}, {R('corr(ra, rb)', 'spearman')}, {R('sqrt(avg((a - b) * (a - b)))', 'rmse')},
    {R('avg(abs(a - b))', 'mae')} FROM r""")
def f11(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 2000).alias("b"))
    return rounded(stats.agreement(rows, "a", "b"))


@query("f12_corr_ci", f"""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_returnflag, n, {R('r')}, {R('tanh(atanh(r) - 1959963984540054e-15 / sqrt(n - 3))', 'ci_lo')},
    {R('tanh(atanh(r) + 1959963984540054e-15 / sqrt(n - 3))', 'ci_hi')} FROM c""")
def f12(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n"))
    return rounded(stats.corr_ci(c, "r", "n"))


@query("f13_bootstrap_mean")
def f13(spark, d):
    return rounded(stats.bootstrap_mean(table(spark, d, "events"), "value", 1000, ["event_type"]))


@query("f14_bootstrap_auc")
def f14(spark, d):
    return rounded(stats.bootstrap_metric(predictions(spark, d), "label", "prob", "auc", 1000))


@query("f14_bootstrap_f1_stratified")
def f14_f1(spark, d):
    return rounded(stats.bootstrap_metric(predictions(spark, d), "label", "prob", "f1", 1000, stratify=True))


def _draw(n: int) -> str:
    """Uniform number of a draw: 48 bits of an md5, as the operator takes them."""
    return f"CAST(CAST('0x' || substr(md5(l_linestatus || ':' || b || ':{n}'), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"


@query("f15_bootstrap_proportion", f"""WITH p AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS p,
    count(*) AS n FROM lineitem GROUP BY 1),
  u AS (SELECT *, {_draw(42)} AS u1, {_draw(43)} AS u2 FROM p, (SELECT unnest(range(1000)) AS b)),
  v AS (SELECT l_linestatus, p, n, least(greatest(p + sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) * sqrt(p * (1 - p) / n), 0), 1) AS x FROM u),
  q AS (SELECT l_linestatus, any_value(p) AS point, any_value(n) AS n, quantile_cont(x, 25e-3) AS ci_lo, quantile_cont(x, 975e-3) AS ci_hi FROM v GROUP BY 1)
  SELECT l_linestatus, {R('point')}, n, {R('ci_lo')}, {R('ci_hi')}, {R('ci_hi - ci_lo', 'ci_width')} FROM q""")
def f15(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    return rounded(stats.bootstrap_proportion(p, "p", "n", 1000, ["l_linestatus"]))


@query("f16_z_test", f"""WITH c AS (SELECT event_type, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1)
  SELECT event_type, {R('m')}, {R('se')}, {R('(m - 50) / se', 'z')} FROM c""")
def f16(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(
        F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return rounded(stats.z_test(c, "m", 50.0, "se", with_p=False))


PVALUES = """pv AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') / count(*) AS p_raw FROM events GROUP BY 1)"""


def p_values(spark, d):
    share = F.count(F.when(F.col("event_type") == "error", 1)) / F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(share.alias("p_raw"))


@query("f17_bh_adjust", f"""WITH {PVALUES}, r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p_raw) + count(*) OVER (PARTITION BY p_raw) - 1 AS rk FROM pv),
  a AS (SELECT *, least(1, p_raw * n / rk) AS raw FROM r),
  s AS (SELECT *, min(raw) OVER (ORDER BY p_raw DESC) AS adj FROM a)
  SELECT user_id, {R('p_raw')}, {R('adj', 'p_bh_adjusted')}, adj <= 2e-1 AS reject FROM s""")
def f17(spark, d):
    return rounded(stats.bh_adjust(p_values(spark, d), "p_raw", 0.20))


@query("f17_bh_plain", f"""WITH {PVALUES}, r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY p_raw) + count(*) OVER (PARTITION BY p_raw) - 1 AS rk FROM pv)
  SELECT user_id, {R('least(1, p_raw * n / rk)', 'p_bh_adjusted')} FROM r""")
def f17_plain(spark, d):
    return rounded(stats.bh_adjust(p_values(spark, d), "p_raw", monotone=False).select("user_id", "p_bh_adjusted"))


@query("f18_origin_slope_test", f"""WITH {MONTHS}, s AS (SELECT grp, sum(n * period * mean_price) / sum(n * period * period) AS m FROM months GROUP BY 1),
  r AS (SELECT grp, any_value(m) AS slope, count(*) AS n, stddev_pop(mean_price - m * period) / (sqrt(sum(period * period)) + 1e-9) AS se FROM months JOIN s USING (grp) GROUP BY 1)
  SELECT grp, {R('slope')}, n, {R('se')}, {R('slope / (se + 1e-9)', 't')} FROM r""")
def f18(spark, d):
    return rounded(stats.origin_slope_test(
        month_series(spark, d), F.col("period").cast("double"), F.col("mean_price"), F.col("n").cast("double"),
        ["grp"], with_p=False))


@query("f19_split_at_quantile", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.8) AS c FROM orders)
  SELECT o_orderkey, o_totalprice > c AS is_high FROM orders, q""")
def f19(spark, d):
    return stats.split_at_quantile(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.8).select(
        "o_orderkey", "is_high")


@query("f20_control_check")
def f20(spark, d):
    by = series.divergence_by_period(doc_distances(spark, d))
    return rounded(stats.control_check(by, 10, by=["grp"]))


@query("f20_late_enrichment", """WITH q AS (SELECT grp, quantile_cont(CAST(length(text) AS DOUBLE), 5e-1) AS c FROM (SELECT lang AS grp, text FROM documents) GROUP BY 1),
  t AS (SELECT lang AS grp, count(*) FILTER (WHERE length(text) > c AND late) AS a, count(*) FILTER (WHERE length(text) > c AND NOT late) AS b,
    count(*) FILTER (WHERE NOT length(text) > c AND late) AS c, count(*) FILTER (WHERE NOT length(text) > c AND NOT late) AS d
    FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) >= 10 AS late FROM documents) JOIN q ON grp = lang GROUP BY 1),
  u AS (SELECT *, CAST(a + b + c + d AS DOUBLE) AS n FROM t),
  v AS (SELECT *, n * pow(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c, 2) / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS x FROM u)
  SELECT grp, a, b, c, d, """ + R("x", "chi2") + ", " + R("sqrt(x / n)", "cramers_v") + ", " + R("(a / (a + b)) / (c / (c + d))", "enrichment") + " FROM v")
def f20_late(spark, d):
    docs = doc_records(spark, d).select("grp", F.length("sequence").alias("size"), (F.col("period") >= 10).alias("late"))
    return rounded(stats.late_enrichment(docs, "size", F.col("late"), ["grp"], with_p=False))


AUDIT = """SELECT '{name}' AS test, avg(v) AS point, avg(v) - 196e-2 * stddev_samp(v) / sqrt(count(v)) AS ci_lo,
  avg(v) + 196e-2 * stddev_samp(v) / sqrt(count(v)) AS ci_hi, avg(v) / stddev_samp(v) AS effect FROM {src}"""


@query("f21_audit_table", f"""WITH a AS ({AUDIT.format(name='quantity', src='(SELECT l_quantity AS v FROM lineitem)')} UNION ALL
    {AUDIT.format(name='value', src='(SELECT value AS v FROM events)')})
  SELECT test, {R('point')}, {R('ci_lo')}, {R('ci_hi')}, {R('effect')},
    format('{{:.3f}} [95% CI: {{:.3f}}, {{:.3f}}]', point, ci_lo, ci_hi) AS text FROM a""")
def f21(spark, d):
    def part(df, col, name):
        se = F.lit(1.96) * F.stddev_samp(col) / F.sqrt(F.count(col))
        return df.agg(F.avg(col).alias("point"), (F.avg(col) - se).alias("ci_lo"), (F.avg(col) + se).alias("ci_hi"),
                      (F.avg(col) / F.stddev_samp(col)).alias("effect")).withColumn("test", F.lit(name))

    return rounded(stats.audit_table([
        part(table(spark, d, "lineitem"), "l_quantity", "quantity"), part(table(spark, d, "events"), "value", "value")], digits=3))


@query("f22_baseline_distance", f"""WITH {DAYS}, b AS (SELECT entity, arg_min(m1, version) AS b1, arg_min(m2, version) AS b2, arg_min(m3, version) AS b3 FROM days GROUP BY 1),
  x AS (SELECT entity, version, sqrt((m1 - b1) * (m1 - b1) + (m2 - b2) * (m2 - b2) + (m3 - b3) * (m3 - b3)) AS distance FROM days JOIN b USING (entity))
  SELECT entity, version, {R('distance')}, CASE WHEN distance > 15e-2 THEN 1 ELSE 0 END AS drift FROM x""")
def f22(spark, d):
    return rounded(stats.baseline_distance(day_metrics(spark, d), ["entity"], "version", ["m1", "m2", "m3"]).select(
        "entity", "version", "distance", "drift"))


@query("f23_cluster_agreement", f"""WITH c AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 3e5 THEN 'F' WHEN o_totalprice > 15e4 THEN 'O' ELSE 'P' END AS b, count(*) AS n FROM orders GROUP BY 1, 2),
  ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1),
  f AS (SELECT avg(2 * coalesce(n, 0) / (coalesce(na, 0) + coalesce(nb, 0))) AS f1 FROM ra FULL JOIN rb ON a = b LEFT JOIN c ON c.a = coalesce(ra.a, rb.b) AND c.b = coalesce(ra.a, rb.b)),
  s AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(na * (na - 1) / 2) FROM ra) AS i, (SELECT sum(nb * (nb - 1) / 2) FROM rb) AS j)
  SELECT n, {R('f1', 'macro_f1')}, {R('(ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2))', 'adjusted_rand')} FROM s, f""")
def f23(spark, d):
    found = F.when(F.col("o_totalprice") > 3e5, "F").when(F.col("o_totalprice") > 1.5e5, "O").otherwise("P")
    return rounded(stats.cluster_agreement(
        table(spark, d, "orders").select("o_orderstatus", found.alias("found")), "o_orderstatus", "found"))


# --- windows, time series, forecasting -----------------------------------------------------


@query("g1_divergence_by_period", f"""WITH {DOC_DIST} SELECT grp, period, {R('avg(distance)', 'mean_distance')},
  {R('coalesce(stddev_samp(distance), 0)', 'std_distance')}, count(distance) AS sample_size,
  {R('avg(distance) FILTER (WHERE distance < ref_length * 9e-1)', 'lineage_mean')},
  count(distance) FILTER (WHERE distance < ref_length * 9e-1) AS lineage_n FROM dist GROUP BY 1, 2""")
def g1(spark, d):
    near = F.col("distance") < F.col("ref_length") * 0.9
    return rounded(series.divergence_by_period(doc_distances(spark, d), lineage=near))


@query("g2_period_rate", f"""WITH {FLAGGED}, g AS (SELECT DISTINCT grp FROM ords), sp AS (SELECT grp, CAST(p AS INTEGER) AS period FROM g, unnest(range(1994, 2004)) u(p)),
  r AS (SELECT grp, period, count(*) AS n FROM ords GROUP BY 1, 2), h AS (SELECT grp, period, count(DISTINCT id) AS k FROM fev WHERE in_region GROUP BY 1, 2)
  SELECT grp, period, coalesce(n, 0) AS n_sequences, coalesce(k, 0) AS n_flagged,
    {R('CASE WHEN coalesce(n, 0) > 0 THEN coalesce(k, 0) * 100e0 / n ELSE 0e0 END', 'pct')} FROM sp LEFT JOIN r USING (grp, period) LEFT JOIN h USING (grp, period)""")
def g2(spark, d):
    records, _, ev = flagged_events(spark, d)
    return rounded(series.period_rate(ev, records, 1994, 2003))


@query("g3_accelerations", f"""WITH {MONTHS}, c AS (SELECT grp, period, finished, finished - lag(finished) OVER (PARTITION BY grp ORDER BY period) AS change FROM months),
  s AS (SELECT *, stddev_samp(change) OVER (PARTITION BY grp) AS sd, first_value(period) OVER (PARTITION BY grp ORDER BY finished DESC, period) AS top,
    first_value(period) OVER (PARTITION BY grp ORDER BY finished, period) AS low FROM c)
  SELECT grp, period, {R('finished')}, {R('change')}, coalesce(change > sd, false) AS accelerating,
    coalesce(abs(change) <= sd * 3e-1, false) AS plateau, period = top AS is_peak, period = low AS is_low FROM s""")
def g3(spark, d):
    m = month_series(spark, d).select("grp", "period", "finished")
    return rounded(series.accelerations(m, "finished", ["grp"]))


@query("g4_period_features", f"""WITH {FLAGGED}, k AS (SELECT DISTINCT grp, period, position, var_char FROM fev),
  nw AS (SELECT a.grp, a.period, count(*) AS c FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.grp = a.grp AND b.period = a.period - 1
    AND b.position = a.position AND b.var_char = a.var_char) GROUP BY 1, 2),
  b AS (SELECT grp, period, count(*) AS n_events, count(*) FILTER (WHERE in_region) AS n_flagged, avg(position) AS mean_position FROM fev GROUP BY 1, 2),
  e AS (SELECT grp, period, CASE WHEN sum(c) > 2 THEN ln(sum(c)) - sum(c * ln(c)) / sum(c) ELSE 0e0 END AS h FROM
    (SELECT grp, period, var_char, count(*) AS c FROM fev WHERE in_region GROUP BY ALL) GROUP BY 1, 2)
  SELECT b.grp, b.period, n_events, n_flagged, CASE WHEN (b.grp, b.period - 1) IN (SELECT grp, period FROM b) THEN coalesce(c, 0) ELSE n_events END AS n_new,
    {R('mean_position')}, {R('n_flagged / n_events', 'frac_flagged')}, {R('greatest(0, coalesce(h, 0))', 'entropy')}
  FROM b LEFT JOIN nw ON nw.grp = b.grp AND nw.period = b.period LEFT JOIN e ON e.grp = b.grp AND e.period = b.period""")
def g4(spark, d):
    return rounded(series.period_features(flagged_events(spark, d)[2]))


@query("g5_cumulative_distinct", f"""WITH {EV}, f AS (SELECT grp, position, var_char, min(period) AS period FROM ev GROUP BY ALL),
  n AS (SELECT grp, period, count(*) AS c FROM f GROUP BY 1, 2), p AS (SELECT DISTINCT grp, period FROM ev)
  SELECT grp, period, coalesce(c, 0) AS n_first_seen, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY grp ORDER BY period) AS BIGINT) AS cumulative
  FROM p LEFT JOIN n USING (grp, period)""")
def g5(spark, d):
    return series.cumulative_distinct(order_events(spark, d)[2])


@query("g6_population_features", f"""WITH {DOC_DIST}, s AS (SELECT *, substr(sequence, 6, 1) AS c FROM dist)
  SELECT grp, period, count(*) AS n, {R('avg(distance / ref_length)', 'mean_distance')}, {R('avg(length(sequence))', 'mean_length')},
    count(DISTINCT place) AS n_labels, {', '.join(R(f"coalesce(count(*) FILTER (WHERE c = '{x}') / nullif(count(*) FILTER (WHERE c IN ('a', 'e', 'i', 'o')), 0), 0)", f'share_{x}') for x in 'aeio')}
  FROM s GROUP BY 1, 2""")
def g6(spark, d):
    return rounded(series.population_features(doc_distances(spark, d), 5, "aeio", "place"))


STATUS = """st AS (SELECT o_orderpriority AS grp, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS period, o_orderstatus AS label FROM orders),
  dm AS (SELECT grp, period, label AS dominant, n AS n_dominant FROM (SELECT grp, period, label, count(*) AS n, row_number() OVER
    (PARTITION BY grp, period ORDER BY count(*) DESC, label) AS rk FROM st GROUP BY grp, period, label) WHERE rk = 1)"""


def statuses(spark, d):
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grp"), month.alias("period"), F.col("o_orderstatus").alias("label"))


@query("g7_next_label", f"""WITH {STATUS} SELECT grp, period, dominant, lead(period) OVER w AS next_period, lead(dominant) OVER w AS next_dominant
  FROM dm WINDOW w AS (PARTITION BY grp ORDER BY period)""")
def g7(spark, d):
    dm = series.dominant(statuses(spark, d), "label", ["grp"]).drop("n_dominant")
    return series.next_label(dm, "dominant", ["grp"])


@query("g8_dominant", f"WITH {STATUS} SELECT * FROM dm")
def g8(spark, d):
    return series.dominant(statuses(spark, d), "label", ["grp"])


@query("g9_persistence", f"""WITH {STATUS} SELECT b.grp, b.period, b.dominant, b.n_dominant, a.dominant AS forecast,
  CASE WHEN a.dominant = b.dominant THEN 1 ELSE 0 END AS hit FROM dm b JOIN dm a ON a.grp = b.grp AND a.period = b.period - 1""")
def g9(spark, d):
    return series.persistence(statuses(spark, d), "label", ["grp"])


CLASSES = ["c0", "c1", "c2"]


@query("g11_adaptive_forecast", f"""WITH {PREDS}, t AS (SELECT CAST(x AS INTEGER) AS t FROM unnest(range(1994, 2012)) u(x)), w(width) AS (VALUES (2), (4), (8)),
  f AS (SELECT t, width, count(period) AS n, coalesce(sum(c0), 0) AS c0, coalesce(sum(c1), 0) AS c1, coalesce(sum(c2), 0) AS c2 FROM t CROSS JOIN w
    LEFT JOIN (SELECT * FROM preds WHERE prob > 4e-1) p ON period BETWEEN t - width + 1 AND t GROUP BY 1, 2),
  s AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN n >= 5 THEN width ELSE 1000 - width END) AS rk FROM f),
  a AS (SELECT avg(c0) AS a0, avg(c1) AS a1, avg(c2) AS a2 FROM preds),
  v AS (SELECT t, width, n, CASE WHEN n > 0 THEN c0 / n ELSE a0 END AS v0, CASE WHEN n > 0 THEN c1 / n ELSE a1 END AS v1, CASE WHEN n > 0 THEN c2 / n ELSE a2 END AS v2 FROM s, a WHERE rk = 1)
  SELECT t AS period, CASE WHEN n > 0 THEN width END AS width, n, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS forecast,
    {R('greatest(v0, v1, v2) / (v0 + v1 + v2 + 1e-12)', 'confidence')} FROM v""")
def g11(spark, d):
    p = predictions(spark, d)
    targets = spark.range(1994, 2012).select(F.col("id").cast("int").alias("period"))
    return rounded(series.adaptive_forecast(p, targets, CLASSES, widths=(2, 4, 8)))


@query("g12_concordance", f"""WITH p AS (SELECT o_orderpriority AS grp, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a, CAST(floor(o_totalprice / 1e5) AS INTEGER) AS f FROM orders)
  SELECT grp, count(*) AS n, {R('avg(CASE WHEN a = f THEN 1e0 ELSE 0e0 END)', 'exact')}, {R('avg(CASE WHEN abs(a - f) <= 1 THEN 1e0 ELSE 0e0 END)', 'within_one')},
    {R('avg(abs(a - f))', 'mean_steps')} FROM p GROUP BY 1""")
def g12(spark, d):
    p = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.substring("o_orderpriority", 1, 1).cast("int").alias("a"),
        F.floor(F.col("o_totalprice") / 1e5).cast("int").alias("f"))
    return rounded(series.concordance(p, "f", "a", ["grp"]))


@query("g13_precision_at_k", f"""WITH {EV}, k AS (SELECT period, position, var_char, count(*) AS score FROM ev GROUP BY ALL),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, position, var_char) AS rk FROM k) WHERE rk <= 10),
  tr AS (SELECT DISTINCT period - 1 AS period, position, var_char FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, position, var_char) AS rk FROM k) WHERE rk <= 15),
  h AS (SELECT period, count(*) AS hits FROM b WHERE (period, position, var_char) IN (SELECT period, position, var_char FROM tr) GROUP BY 1)
  SELECT period, coalesce(hits, 0) AS hits, {R('coalesce(hits, 0) / 10', 'precision_at_k')} FROM (SELECT DISTINCT period FROM k) LEFT JOIN h USING (period)""")
def g13(spark, d):
    k = order_events(spark, d)[2].groupBy("period", "position", "var_char").agg(F.count(F.lit(1)).alias("score"))
    truth = sequence.top_variants(k, 15, ["period"], "score", ["position", "var_char"]).withColumn(
        "period", F.col("period") - 1)
    return rounded(series.precision_at_k(k, truth, 10, ["position", "var_char"]))


TRENDS = f"""{EV}, pr AS (SELECT grp, period, count(*) AS m FROM ords GROUP BY 1, 2),
  tr AS (SELECT grp, position, ref_char, var_char, period, count(*) / any_value(m) AS frequency FROM ev JOIN pr USING (grp, period) GROUP BY ALL)"""


def trends(spark, d):
    records, _, ev = order_events(spark, d)
    rows = records.groupBy("grp", "period").agg(F.count(F.lit(1)).alias("m"))
    n = ev.groupBy(*sequence.VARIANT, "period").agg(F.count(F.lit(1)).alias("n"))
    return n.join(rows, ["grp", "period"]).select(*sequence.VARIANT, "period", (F.col("n") / F.col("m")).alias("frequency"))


@query("g14_key_trends", f"""WITH {TRENDS} SELECT grp, position, ref_char, var_char, {R('regr_slope(frequency, period)', 'slope')}, {R('regr_r2(frequency, period)', 'r2')},
  count(*) AS n_periods, {R('arg_min(frequency, period)', 'start')}, {R('arg_max(frequency, period)', 'end')} FROM tr GROUP BY ALL HAVING count(*) >= 4""")
def g14(spark, d):
    return rounded(series.key_trends(trends(spark, d), with_p=False))


@query("g14_key_trends_p")
def g14_p(spark, d):
    return rounded(series.key_trends(trends(spark, d)))


POLY = """c AS (SELECT entity, version, m1 AS y, version - avg(version) OVER (PARTITION BY entity) AS u, avg(version) OVER (PARTITION BY entity) AS m FROM days),
  s AS (SELECT entity, any_value(m) AS m, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2, sum(y * y) AS vv FROM c GROUP BY 1),
  a AS (SELECT *, (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2) AS a2 FROM s),
  b AS (SELECT *, (t1 - a2 * s3) / s2 AS a1, (t0 - a2 * s2) / n AS a0 FROM a),
  fit AS (SELECT *, 1 - (vv - a0 * t0 - a1 * t1 - a2 * t2) / (vv - t0 * t0 / n) AS r2 FROM b)"""


@query("g15_poly_fit", f"""WITH {DAYS}, {POLY} SELECT entity, n, {R('a2', 'c2')}, {R('a1 - 2 * a2 * m', 'c1')}, {R('a0 - a1 * m + a2 * m * m', 'c0')}, {R('r2')},
  CASE WHEN a2 > 1e-3 THEN 'Accelerating' WHEN a2 < -1e-3 THEN 'Decelerating' ELSE 'Linear' END AS trajectory FROM fit""")
def g15(spark, d):
    return rounded(series.poly_fit(day_metrics(spark, d), "version", "m1", ["entity"]))


@query("g15_poly_trend", f"""WITH {DAYS}, {POLY} SELECT days.entity, version, {R('a0 + a1 * (version - m) + a2 * (version - m) * (version - m)', 'poly_fit')},
  {R('a1 + 2 * a2 * (version - m)', 'velocity')}, {R('m1 - (a0 + a1 * (version - m) + a2 * (version - m) * (version - m))', 'residual')} FROM days JOIN fit USING (entity)""")
def g15_trend(spark, d):
    return rounded(series.poly_trend(day_metrics(spark, d), "version", "m1", ["entity"]).select(
        "entity", "version", "poly_fit", "velocity", "residual"))


@query("g16_lag_windows", f"""WITH {DAYS}, w AS (SELECT entity, version, list(n) OVER (PARTITION BY entity ORDER BY version ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS win FROM days)
  SELECT entity, version, array_to_string(win, ',') AS win FROM w WHERE len(win) = 5""")
def g16(spark, d):
    w = series.lag_windows(day_metrics(spark, d).select("entity", "version", "n"), 5, "n", "version", ["entity"])
    return w.select("entity", "version", F.concat_ws(",", F.col("window").cast("array<string>")).alias("win"))


def _ar_sql(src: str) -> str:
    return f"""l AS (SELECT entity, version, m1 AS y, lag(m1) OVER w AS l FROM {src} WINDOW w AS (PARTITION BY entity ORDER BY version)),
  z AS (SELECT *, y - l AS z, lag(y - l) OVER (PARTITION BY entity ORDER BY version) AS zl FROM l),
  ar AS (SELECT entity, max(version) AS last_order, arg_max(y, version) AS yt, arg_max(z, version) AS zt, regr_slope(y, l) AS p0, regr_intercept(y, l) AS a0,
    regr_syy(y, l) * (1 - regr_r2(y, l)) / (regr_count(y, l) - 2) AS v0, regr_slope(z, zl) AS p1, regr_intercept(z, zl) AS a1,
    regr_syy(z, zl) * (1 - regr_r2(z, zl)) / (regr_count(z, zl) - 2) AS v1 FROM z GROUP BY 1),
  fp AS (SELECT *, CASE WHEN p0 >= 95e-2 THEN 1 ELSE 0 END AS d, CASE WHEN p0 >= 95e-2 THEN p1 ELSE p0 END AS p, CASE WHEN p0 >= 95e-2 THEN a1 ELSE a0 END AS a,
    CASE WHEN p0 >= 95e-2 THEN v1 ELSE v0 END AS v FROM ar)"""


@query("g17_ar1_forecast", f"""WITH {DAYS}, {_ar_sql('days')}, k AS (SELECT *, CAST(step AS INTEGER) AS k, a / (1 - p) AS mu FROM fp, unnest(range(1, 6)) u(step)),
  f AS (SELECT *, CASE WHEN d = 1 THEN yt + mu * k + (zt - mu) * p * (1 - p ** k) / (1 - p) ELSE mu + p ** k * (yt - mu) END AS fc,
    CASE WHEN d = 1 THEN v * list_sum(list_transform(range(1, k + 1), lambda j: ((1 - p ** j) / (1 - p)) ** 2)) ELSE v * (1 - (p * p) ** k) / (1 - p * p) END AS var FROM k)
  SELECT entity, last_order, k AS step, d, {R('fc', 'forecast')}, {R('fc - 1959963984540054e-15 * sqrt(var)', 'ci_lower')}, {R('fc + 1959963984540054e-15 * sqrt(var)', 'ci_upper')} FROM f""")
def g17(spark, d):
    return rounded(series.ar1_forecast(day_metrics(spark, d), "m1", 5, "version", ["entity"]))


@query("g17_ar1_holdout", f"""WITH {DAYS}, rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY version DESC) AS back FROM days),
  tr AS (SELECT * FROM rk WHERE back > 3), {_ar_sql('tr')}, f AS (SELECT rk.entity, m1, CASE WHEN d = 1 THEN yt + a / (1 - p) * (4 - back) + (zt - a / (1 - p)) * p * (1 - p ** (4 - back)) / (1 - p)
    ELSE a / (1 - p) + p ** (4 - back) * (yt - a / (1 - p)) END AS fc FROM rk JOIN fp USING (entity) WHERE back <= 3)
  SELECT entity, {R('avg(abs(m1 - fc))', 'mae')}, {R('avg(abs((m1 - fc) / (m1 + 1e-9))) * 100', 'mape')},
    CASE WHEN avg(abs((m1 - fc) / (m1 + 1e-9))) * 100 < 15 THEN 'PASS' ELSE 'FAIL' END AS status FROM f GROUP BY 1""")
def g17_holdout(spark, d):
    return rounded(series.ar1_holdout(day_metrics(spark, d), "m1", 3, "version", ["entity"]))


@query("g18_rolling_mean", f"""WITH {MONTHS} SELECT grp, period, {R('CASE WHEN count(*) OVER w = 3 THEN avg(mean_price) OVER w END', 'rolling_mean')}
  FROM months WINDOW w AS (PARTITION BY grp ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def g18(spark, d):
    return rounded(series.rolling_mean(month_series(spark, d), 3, "mean_price", by=["grp"]).select("grp", "period", "rolling_mean"))


@query("g19_lag_influence", f"""WITH {MONTHS}, l AS (SELECT grp, mean_price AS y, lag(mean_price, 1) OVER w AS l1, lag(mean_price, 2) OVER w AS l2, lag(mean_price, 3) OVER w AS l3
    FROM months WINDOW w AS (PARTITION BY grp ORDER BY period))
  SELECT grp, 1 AS lag, {R('corr(y, l1)', 'correlation')} FROM l GROUP BY 1 UNION ALL SELECT grp, 2, {R('corr(y, l2)', 'correlation')} FROM l GROUP BY 1
  UNION ALL SELECT grp, 3, {R('corr(y, l3)', 'correlation')} FROM l GROUP BY 1""")
def g19(spark, d):
    return rounded(series.lag_influence(month_series(spark, d), 3, "mean_price", by=["grp"]))


@query("g20_mean_class_forecast", f"""WITH {PREDS}, m AS (SELECT avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM preds WHERE period >= 1999 AND prob > 5e-1)
  SELECT u.class, {R('u.v / (c0 + c1 + c2)', 'probability')}, u.v = greatest(c0, c1, c2) AS is_best FROM m, LATERAL (VALUES ('c0', c0), ('c1', c1), ('c2', c2)) u(class, v)""")
def g20(spark, d):
    return rounded(series.mean_class_forecast(predictions(spark, d), CLASSES, 1999))
