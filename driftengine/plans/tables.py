"""Sources and sinks, cleaning, profiling and joins over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftengine.operators import clean, joins, profile
from driftengine.operators.sequence import variant_frequency
from driftengine.plans.data import (
    DOCS,
    EV,
    ORDS,
    R,
    doc_records,
    order_events,
    order_records,
    rounded,
    table,
)
from driftengine.plans.registry import query
from driftengine.scale import shared_dir
from driftengine.sources import io


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------


@query("a1_read_records", "SELECT * FROM customer")
def a1(spark, d):
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return io.read_records(spark, f"{d}/customer.parquet", schema, "parquet")


@query("a1_read_delimited", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def a1_csv(spark, d):
    path = _fresh(spark, "suppliers")
    io.write_table(table(spark, d, "supplier"), path, "tsv")
    return io.read_records(
        spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "tsv")


@query("a2_normalize_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a2(spark, d):
    return io.normalize_columns(table(spark, d, "nation").toDF(" N_NationKey", "N_NAME ", "n_RegionKey"))


@query("a3_read_fasta", f"WITH {ORDS} SELECT CAST(id AS VARCHAR) AS id, period, place, sequence FROM ords")
def a3(spark, d):
    path = _fresh(spark, "fasta")
    io.write_fasta(order_records(spark, d), path, ["id", "period", "place"], width=5)
    return io.read_fasta(spark, path)


@query("a4_fasta_lines", f"""WITH {ORDS} SELECT '>' || id || '|' || period || '|' || replace(grp, ' ', '_')
  || chr(10) || rtrim(regexp_replace(sequence, '(.{{3}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM ords""")
def a4(spark, d):
    return io.fasta_lines(order_records(spark, d), ["id", "period", "grp"], width=3)


@query("a5_write_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def a5(spark, d):
    path = _fresh(spark, "orders")
    io.write_table(table(spark, d, "orders"), path, "json", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return io.read_records(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", "json")


@query("a6_overlay", """WITH patch AS (SELECT c_custkey, c_mktsegment, 0e0 AS c_acctbal FROM customer
    WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
  SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE NOT (c_mktsegment = 'BUILDING'
    AND c_custkey IN (SELECT c_custkey FROM patch)) UNION ALL SELECT * FROM patch""")
def a6(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patch = base.where((F.col("c_acctbal") < 0) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    patch = patch.withColumn("c_acctbal", F.lit(0.0))
    return io.overlay(base, patch, ["c_custkey"], F.col("c_mktsegment") == "BUILDING")


@query("a7_attach_metadata", "SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS length FROM documents")
def a7(spark, d):
    docs = table(spark, d, "documents")
    seqs = docs.select("doc_id", F.col("text").alias("sequence"))
    return io.attach_metadata(seqs, docs.select("doc_id", "lang", "source"), "doc_id").drop("sequence")


@query("a8_manifest", """SELECT DISTINCT url AS key, 'web' AS source, 'https://archive.test/' || url AS url,
  substr(sha256(url), 1, 16) AS sha256_short FROM pages""")
def a8(spark, d):
    return io.manifest(table(spark, d, "pages"), "url", "web", "https://archive.test/")


LINE_COLUMNS = ["l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity",
                "l_returnflag", "l_shipdate", "l_suppkey", "l_tax"]


def _row_json() -> str:
    """A row as JSON with its columns in the order of their names; times in UTC."""
    value = {"l_shipdate": "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000')"}
    return "to_json(struct_pack(" + ", ".join(f"{c} := {value.get(c, c)}" for c in LINE_COLUMNS) + "))"


@query("a9_content_fingerprint", f"""WITH h AS (SELECT sha256(CAST({_row_json()} AS VARCHAR)) AS x FROM lineitem)
  SELECT count(*) AS n_rows, bit_xor(CAST('0x' || substr(x, 1, 15) AS BIGINT)) AS xor_hash,
    CAST(sum(CAST('0x' || substr(x, 16, 15) AS BIGINT)) AS VARCHAR) AS sum_hash FROM h""")
def a9(spark, d):
    return io.content_fingerprint(table(spark, d, "lineitem"))


# --- projections, filters, cleaning, labels ------------------------------------------------

LABELLED = """lab AS (SELECT doc_id, lang, quality, toxic, CAST(length(text) AS INTEGER) AS length
  FROM documents LEFT JOIN labels USING (doc_id))"""


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("length"))
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


@query("b1_drop_null", f"WITH {LABELLED} SELECT * FROM lab WHERE quality IS NOT NULL")
def b1(spark, d):
    return clean.drop_null(labelled(spark, d), ["quality"]).select("doc_id", "lang", "quality", "toxic", "length")


@query("b1_dropped_count", f"""WITH {LABELLED} SELECT count(*) AS n_rows, count(quality) AS n_kept,
  count(*) - count(quality) AS n_dropped FROM lab""")
def b1_count(spark, d):
    return clean.dropped_count(labelled(spark, d), ["quality"])


@query("b2_coerce_int", """SELECT p_partkey, CAST(TRY_CAST(raw AS DOUBLE) AS INTEGER) AS raw FROM (
  SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS raw FROM part)
  WHERE TRY_CAST(raw AS DOUBLE) IS NOT NULL""")
def b2(spark, d):
    raw = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    return clean.coerce_int(table(spark, d, "part").select("p_partkey", raw.alias("raw")), "raw")


@query("b3_with_length", f"WITH {DOCS} SELECT id, CAST(length(sequence) AS INTEGER) AS length FROM docs")
def b3(spark, d):
    return clean.with_length(doc_records(spark, d)).select("id", "length")


@query("b4_filters", f"""WITH {DOCS} SELECT id, grp FROM docs WHERE grp IN ('en', 'de') AND place <> 'src0'
  AND contains(lower(sequence), 'the')""")
def b4(spark, d):
    rows = clean.one_of(doc_records(spark, d), "grp", ["en", "de"]).where(F.col("place") != "src0")
    return clean.contains_text(rows, "sequence", "THE").select("id", "grp")


@query("b4_equals", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def b4_equals(spark, d):
    return clean.equals(table(spark, d, "orders"), "o_orderstatus", "P").select("o_orderkey")


@query("b5_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1e5 AND 2e5")
def b5(spark, d):
    return clean.between(table(spark, d, "orders"), "o_totalprice", 1e5, 2e5).select("o_orderkey", "o_totalprice")


@query("b6_canonical", r"SELECT page_id, upper(trim(url, E' \t\n\r\f\v')) AS sequence FROM pages")
def b6(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("sequence"))
    return clean.canonical(pages)


@query("b7_min_length", f"WITH {DOCS} SELECT grp, count(*) AS n FROM docs WHERE length(sequence) > 50 GROUP BY 1")
def b7(spark, d):
    return clean.min_length(doc_records(spark, d), 50).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


MODAL = """m AS (SELECT grp, len AS modal_length FROM (SELECT grp, length(sequence) AS len,
  row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, length(sequence)) AS rk
  FROM ords GROUP BY grp, length(sequence)) WHERE rk = 1)"""


@query("b8_modal_length", f"""WITH {ORDS}, {MODAL} SELECT id, grp, CAST(length(sequence) AS INTEGER) AS length,
  CAST(modal_length AS INTEGER) AS modal_length FROM ords JOIN m USING (grp) WHERE length(sequence) = modal_length""")
def b8(spark, d):
    return clean.modal_length(order_records(spark, d), ["grp"]).select("id", "grp", "length", "modal_length")


@query("b9_length_band", f"""WITH {ORDS}, {MODAL} SELECT id, grp, CAST(length(sequence) AS INTEGER) AS length
  FROM ords JOIN m USING (grp) WHERE length(sequence) BETWEEN modal_length * 75e-2 AND modal_length * 125e-2""")
def b9(spark, d):
    return clean.length_band(order_records(spark, d), 0.25, ["grp"]).select("id", "grp", "length")


URL = r"^https?://[a-z0-9.-]+\.example\.(com|org)/[a-z]{2}/[0-9]+$"


@query("b10_format_valid", f"SELECT page_id, regexp_matches(url, '{URL}') AS valid FROM pages")
def b10(spark, d):
    return clean.format_valid(table(spark, d, "pages"), "url", URL).select("page_id", "valid")


@query("b10_format_rate", f"""SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_valid,
  {R('count(*) FILTER (WHERE ok) * 100e0 / count(*)', 'valid_pct')}
  FROM (SELECT regexp_matches(url, '{URL}') AS ok FROM pages)""")
def b10_rate(spark, d):
    return rounded(clean.format_rate(table(spark, d, "pages"), "url", URL))


@query("b11_in_alphabet", f"""WITH {EV} SELECT id, position, ref_char, var_char FROM ev
  WHERE ref_char IN ('A', 'C', 'E', 'G', 'I', 'K') AND var_char IN ('A', 'C', 'E', 'G', 'I', 'K')""")
def b11(spark, d):
    _, _, ev = order_events(spark, d)
    return clean.in_alphabet(ev, ["ref_char", "var_char"], "ACEGIK").select("id", "position", "ref_char", "var_char")


@query("b12_classify_length", f"""WITH {DOCS} SELECT id, CASE WHEN length(sequence) >= 1000 THEN 'complete'
  ELSE 'partial' END AS completeness FROM docs""")
def b12(spark, d):
    return clean.classify_length(doc_records(spark, d), 1000).select("id", "completeness")


EDGES = [0, 100, 500, 1000, 5000, float("inf")]
NAMES = ["<100", "100-499", "500-999", "1000-4999", ">=5000"]
BIN_SQL = """CASE WHEN length(sequence) < 100 THEN '<100' WHEN length(sequence) < 500 THEN '100-499'
  WHEN length(sequence) < 1000 THEN '500-999' WHEN length(sequence) < 5000 THEN '1000-4999' ELSE '>=5000' END"""


@query("b13_bin_edges", f"WITH {DOCS} SELECT id, {BIN_SQL} AS bin FROM docs")
def b13(spark, d):
    return clean.bin_edges(clean.with_length(doc_records(spark, d)), "length", EDGES, NAMES).select("id", "bin")


@query("b14_bin_width", """SELECT o_orderkey, CAST(least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin
  FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def b14(spark, d):
    return clean.bin_width(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20).select(
        "o_orderkey", "bin")


@query("b15_bin_quantile", """SELECT o_orderkey, CAST((o_totalprice > q1)::INT + (o_totalprice > q2)::INT
    + (o_totalprice > q3)::INT + (o_totalprice > q4)::INT AS INTEGER) AS bin
  FROM orders, (SELECT quantile_cont(o_totalprice, 0.2) AS q1, quantile_cont(o_totalprice, 0.4) AS q2,
    quantile_cont(o_totalprice, 0.6) AS q3, quantile_cont(o_totalprice, 0.8) AS q4 FROM orders)""")
def b15(spark, d):
    return clean.bin_quantile(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5).select(
        "o_orderkey", "bin")


@query("b16_bin_step", """SELECT p_partkey, CAST(least(greatest(floor(p_size / 7), 1), 5) AS INTEGER) AS bin FROM part""")
def b16(spark, d):
    return clean.bin_step(table(spark, d, "part"), "p_size", 7, 1, 5).select("p_partkey", "bin")


ERAS = [("early", 1993, 1996, 0), ("middle", 1996, 1999, 1), ("late", 2000, 2001, 2)]


def eras(spark):
    return spark.createDataFrame(ERAS, "name string, start int, end int, ordinal int")


@query("b17_label_interval", f"""WITH {ORDS} SELECT id, period, CASE WHEN period IS NULL THEN 'Unknown'
  WHEN period >= 1993 AND period < 1996 THEN 'early' WHEN period >= 1996 AND period < 1999 THEN 'middle'
  WHEN period >= 2000 AND period < 2001 THEN 'late' ELSE 'Other' END AS label FROM ords""")
def b17(spark, d):
    return clean.label_interval(order_records(spark, d), eras(spark)).select("id", "period", "label")


@query("b18_label_ordinal", f"""WITH {ORDS}, o AS (SELECT id, period, CASE WHEN period < 1996 THEN 0
    WHEN period < 1999 THEN 1 ELSE 2 END AS ordinal FROM ords)
  SELECT id, period, ordinal, CASE ordinal WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS cluster_name,
    CASE WHEN ordinal >= 1 THEN 1 ELSE 0 END AS label FROM o""")
def b18(spark, d):
    return clean.label_ordinal(order_records(spark, d), eras(spark), 1).select(
        "id", "period", "ordinal", "cluster_name", "label")


@query("b19_label_contains", """SELECT p_partkey, CASE WHEN contains(upper(p_name), 'RED') THEN 'warm'
  WHEN contains(upper(p_name), 'BLUE') THEN 'cold' ELSE 'Other' END AS label FROM part""")
def b19(spark, d):
    return clean.label_contains(table(spark, d, "part"), "p_name", [("red", "warm"), ("blue", "cold")]).select(
        "p_partkey", "label")


@query("b20_symbol_attributes", f"""WITH {EV}, a AS (SELECT *, (ascii(ref_char) - 65) * 1e-1 AS ref_step,
    (ascii(var_char) - 65) * 1e-1 AS var_step FROM ev)
  SELECT id, position, {R('ref_step')}, {R('var_step')}, {R('var_step - ref_step', 'step_delta')},
    CASE WHEN var_step <> ref_step THEN 1 ELSE 0 END AS step_changed FROM a""")
def b20(spark, d):
    _, _, ev = order_events(spark, d)
    dim = spark.createDataFrame([(chr(65 + i), i * 0.1) for i in range(11)], "symbol string, value double")
    return rounded(clean.symbol_attributes(ev, "ref_char", "var_char", dim, "step").select(
        "id", "position", "ref_step", "var_step", "step_delta", "step_changed"))


@query("b21_pair_score", f"""WITH {EV}, m(a, b, score) AS (VALUES ('A', 'B', 2), ('C', 'B', 1), ('A', 'D', -1), ('E', 'G', 3)),
  k AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, score FROM m)
  SELECT id, position, CAST(coalesce(score, -4) AS INTEGER) AS score,
    CASE WHEN coalesce(score, -4) >= 1 THEN 1 ELSE 0 END AS conservative
  FROM ev LEFT JOIN k ON lo = least(ref_char, var_char) AND hi = greatest(ref_char, var_char)""")
def b21(spark, d):
    _, _, ev = order_events(spark, d)
    m = spark.createDataFrame([("A", "B", 2), ("C", "B", 1), ("A", "D", -1), ("E", "G", 3)], "a string, b string, score int")
    return clean.pair_score(ev, "ref_char", "var_char", m).select("id", "position", "score", "conservative")


@query("b22_normalize_clip", f"SELECT o_orderkey, {R('least(greatest(o_totalprice, 0), 299999e0) / 299999e0', 'v')} FROM orders")
def b22_clip(spark, d):
    return rounded(clean.normalize(table(spark, d, "orders"), "o_totalprice", "clip", "v", 299999.0).select("o_orderkey", "v"))


@query("b22_normalize_log", f"""SELECT o_orderkey, {R('ln(1 + o_totalprice) / (ln(1 + hi) + 1e-9)', 'v')}
  FROM orders, (SELECT max(o_totalprice) AS hi FROM orders)""")
def b22_log(spark, d):
    return rounded(clean.normalize(table(spark, d, "orders"), "o_totalprice", "log1p_max", "v").select("o_orderkey", "v"))


@query("b22_normalize_min_max", f"""SELECT o_orderkey, {R('(o_totalprice - lo) / (hi - lo)', 'v')}
  FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def b22_minmax(spark, d):
    return rounded(clean.normalize(table(spark, d, "orders"), "o_totalprice", "min_max", "v").select("o_orderkey", "v"))


@query("b22_normalize_rank", f"""SELECT p_partkey, {R('(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0) / count(*) OVER ()', 'v')}
  FROM part""")
def b22_rank(spark, d):
    return rounded(clean.normalize(table(spark, d, "part"), "p_size", "percent_rank", "v").select("p_partkey", "v"))


@query("b23_weighted_score", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  {R('l_quantity / 50 * 5e-1 + l_discount * 3e-1 + l_tax * 2e-1', 'score')},
  {R('l_quantity / 50 * l_discount', 'product')} FROM lineitem""")
def b23(spark, d):
    rows = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity") / 50)
    scored = clean.weighted_score(rows, {"q": 0.5, "l_discount": 0.3, "l_tax": 0.2})
    scored = clean.product_score(scored, ["q", "l_discount"], "product")
    return rounded(scored.select("l_orderkey", "l_linenumber", "l_partkey", "score", "product"))


@query("b24_evidence_score", f"""WITH p AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END
    + CASE WHEN l_discount >= 5e-2 THEN 2 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS points FROM lineitem)
  SELECT points, {R('points / 6', 'evidence')}, CASE WHEN points / 6 >= 4e-1 THEN 1 ELSE 0 END AS supported,
  count(*) AS n FROM p GROUP BY points""")
def b24(spark, d):
    rules = [(F.col("l_returnflag") == "R", 3), (F.col("l_discount") >= 0.05, 2), (F.col("l_quantity") > 40, 1)]
    scored = clean.evidence_score(table(spark, d, "lineitem"), rules, 6, 0.40)
    return rounded(scored.groupBy("points", "evidence", "supported").agg(F.count(F.lit(1)).alias("n")))


@query("b25_label_with_fallback", """SELECT doc_id, coalesce(quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS quality,
  quality IS NULL AS from_rule FROM documents LEFT JOIN labels USING (doc_id)""")
def b25(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    rule = (F.col("n_chars") > 1000).cast("int")
    out = clean.label_with_fallback(docs, table(spark, d, "labels"), "doc_id", "quality", rule)
    return out.select("doc_id", "quality", "from_rule")


# --- profiling, quality, aggregation, pivots -----------------------------------------------


def _completeness_sql(cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS filled, count(*) - count({c}) AS missing,
        {R(f'count({c}) * 100e0 / count(*)', 'pct_filled')} FROM lab""" for c in cols)


@query("c1_completeness", f"WITH {LABELLED} " + _completeness_sql(["doc_id", "lang", "length", "quality", "toxic"]))
def c1(spark, d):
    return rounded(profile.completeness(labelled(spark, d)))


@query("c2_duplicate_stats", f"""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang)
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_repeats,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_in_groups,
  {R('sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100e0 / sum(n)', 'pct_in_groups')} FROM g""")
def c2(spark, d):
    return rounded(profile.duplicate_stats(table(spark, d, "documents"), ["text", "lang"]))


@query("c3_dedupe", """SELECT user_id, event_type, event_id, value FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rk FROM events) WHERE rk = 1""")
def c3(spark, d):
    return profile.dedupe(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value")


@query("c4_summary", f"""SELECT event_type, count(value) AS n, {R('min(value)', 'min')}, {R('max(value)', 'max')},
  {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'std')}, {R('median(value)', 'median')} FROM events GROUP BY 1""")
def c4(spark, d):
    return rounded(profile.summary(table(spark, d, "events"), "value", ["event_type"]))


@query("c4_summary_global", f"""SELECT count(o_totalprice) AS n, {R('min(o_totalprice)', 'min')}, {R('max(o_totalprice)', 'max')},
  {R('avg(o_totalprice)', 'mean')}, {R('stddev_samp(o_totalprice)', 'std')}, {R('median(o_totalprice)', 'median')} FROM orders""")
def c4_global(spark, d):
    return rounded(profile.summary(table(spark, d, "orders"), "o_totalprice"))


@query("c5_value_counts", f"""SELECT p_brand, count(*) AS n, {R('count(*) * 100e0 / (SELECT count(*) FROM part)', 'pct')}
  FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def c5(spark, d):
    return rounded(profile.value_counts(table(spark, d, "part"), "p_brand", 10))


@query("c6_coverage_gaps", f"""WITH {ORDS} SELECT grp, CAST(p AS INTEGER) AS period FROM (SELECT DISTINCT grp FROM ords),
  unnest(range(1990, 2004)) AS u(p) WHERE (grp, p) NOT IN (SELECT grp, period FROM ords)""")
def c6(spark, d):
    return profile.coverage_gaps(order_records(spark, d), 1990, 2003, ["grp"])


@query("c7_profile_by", f"""WITH {DOCS} SELECT grp, count(*) AS n, min(period) AS min_period, max(period) AS max_period,
  count(DISTINCT place) AS n_places, count(DISTINCT id) AS n_keys,
  {R("avg(CASE WHEN length(sequence) >= 500 THEN 1e0 ELSE 0e0 END) * 100", 'valid_pct')} FROM docs GROUP BY 1""")
def c7(spark, d):
    return rounded(profile.profile_by(doc_records(spark, d), ["grp"], "id", "place", F.length("sequence") >= 500))


@query("c8_count_matrix", f"""WITH {DOCS} SELECT period, count(*) FILTER (WHERE grp = 'de') AS de,
  count(*) FILTER (WHERE grp = 'en') AS en, count(*) FILTER (WHERE grp = 'es') AS es,
  count(*) FILTER (WHERE grp = 'fr') AS fr, count(*) AS "Total" FROM docs GROUP BY 1""")
def c8(spark, d):
    return profile.count_matrix(doc_records(spark, d), "period", "grp", ["de", "en", "es", "fr"])


@query("c9_grouped_summary", f"""WITH {ORDS}, l AS (SELECT *, CAST(length(sequence) AS INTEGER) AS len FROM ords),
  m AS (SELECT grp, period, len, row_number() OVER (PARTITION BY grp, period ORDER BY count(*) DESC, len) AS rk
    FROM l GROUP BY grp, period, len)
  SELECT grp, period, count(l.len) AS count, min(l.len) AS min, max(l.len) AS max, {R('avg(l.len)', 'mean')},
    {R('stddev_samp(l.len)', 'std')}, any_value(m.len) AS mode FROM l JOIN m USING (grp, period)
  WHERE rk = 1 GROUP BY grp, period""")
def c9(spark, d):
    return rounded(profile.grouped_summary(clean.with_length(order_records(spark, d)), ["grp", "period"], "length"))


@query("c10_iqr_outliers", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM events GROUP BY 1)
  SELECT event_id, (value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)) AS is_outlier
  FROM events JOIN q USING (event_type)""")
def c10(spark, d):
    return profile.iqr_outliers(table(spark, d, "events"), "value", 1.5, "both", ["event_type"]).select(
        "event_id", "is_outlier")


@query("c10_iqr_upper", """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
  SELECT count(*) FILTER (WHERE n_chars > q3 + 3 * (q3 - q1)) AS n_outliers, count(*) AS n FROM documents, q""")
def c10_upper(spark, d):
    flagged = profile.iqr_outliers(table(spark, d, "documents").select("n_chars"), "n_chars", 3.0, "upper")
    return flagged.agg(F.count(F.when(F.col("is_outlier"), 1)).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


@query("c11_head_per_group", """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type
  ORDER BY ts, event_id) AS rk FROM events) WHERE rk <= 50""")
def c11(spark, d):
    return profile.head_per_group(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 50).select(
        "event_type", "event_id")


@query("c12_rate_by", f"""WITH {DOCS} SELECT period, count(*) AS n, count(*) FILTER (WHERE length(sequence) >= 1000) AS n_true,
  {R('avg(CASE WHEN length(sequence) >= 1000 THEN 1e0 ELSE 0e0 END)', 'rate')} FROM docs GROUP BY 1""")
def c12(spark, d):
    return rounded(profile.rate_by(doc_records(spark, d), ["period"], F.length("sequence") >= 1000))


@query("c13_histogram", f"""WITH {DOCS}, b AS (SELECT {BIN_SQL} AS bin FROM docs)
  SELECT s.bin, count(b.bin) AS n FROM (VALUES ('<100'), ('100-499'), ('500-999'), ('1000-4999'), ('>=5000')) s(bin)
  LEFT JOIN b ON b.bin = s.bin GROUP BY 1""")
def c13(spark, d):
    return profile.histogram(clean.with_length(doc_records(spark, d)), "length", EDGES, NAMES)


@query("c14_quality_verdict", f"""WITH b AS (SELECT doc_id, text, lang, CAST(length(text) AS INTEGER) AS length, quality
    FROM documents LEFT JOIN labels USING (doc_id)),
  q AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.75) AS q3 FROM b),
  dup AS (SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100e0 / sum(n) AS p FROM (SELECT count(*) AS n FROM b GROUP BY text, lang)),
  miss AS (SELECT (5 * count(*) - count(doc_id) - count(text) - count(lang) - count(length) - count(quality)) * 100e0
    / (5 * count(*)) AS p FROM b),
  ok AS (SELECT avg(CASE WHEN regexp_matches(CAST(doc_id AS VARCHAR), '^[0-9]{{2,}}$') THEN 1e0 ELSE 0e0 END) * 100 AS p FROM b),
  len AS (SELECT 100 - avg(CASE WHEN length > q3 + 3 * (q3 - q1) OR length < q1 - 3 * (q3 - q1) THEN 1e0 ELSE 0e0 END) * 100 AS p FROM b, q)
  SELECT {R('dup.p', 'duplicate_pct')}, {R('miss.p', 'missing_pct')}, {R('ok.p', 'valid_pct')}, {R('len.p', 'consistent_pct')},
    CASE WHEN dup.p < 1 THEN 'CLEAN' ELSE 'FLAG' END AS verdict FROM dup, miss, ok, len""")
def c14(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.length("text").alias("length"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rounded(profile.quality_verdict(rows, ["text", "lang"], "doc_id", "^[0-9]{2,}$", "length"))


BRANDS = [f"Brand#{i}" for i in range(1, 6)]


@query("c15_crosstab", "SELECT p_type, " + ", ".join(
    f"""count(*) FILTER (WHERE p_brand = '{b}') AS "{b}\"""" for b in BRANDS) + " FROM part GROUP BY 1")
def c15(spark, d):
    return profile.crosstab(table(spark, d, "part"), "p_type", "p_brand", BRANDS)


@query("c16_profile_rollup", f"""WITH {DOCS}, l AS (SELECT *, length(sequence) AS len FROM docs)
  SELECT coalesce(grp, 'TOTAL') AS grp, count(*) AS "N_total", count(*) FILTER (WHERE len >= 1000) AS n_long,
    count(*) FILTER (WHERE len < 100) AS n_short, min(period) AS min_period, max(period) AS max_period,
    count(DISTINCT place) AS "N_places", {R('avg(len)', 'mean_length')}, {R('stddev_samp(len)', 'std_length')},
    {R('median(len)', 'median_length')} FROM l GROUP BY ROLLUP (grp)""")
def c16(spark, d):
    rows = clean.with_length(doc_records(spark, d))
    conditions = {"n_long": F.col("length") >= 1000, "n_short": F.col("length") < 100}
    return rounded(profile.profile_rollup(rows, "grp", conditions, "place", "length"))


# --- joins and set operations --------------------------------------------------------------


@query("j1_inner_on", """SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)""")
def j1(spark, d):
    return joins.inner_on(table(spark, d, "documents").select("doc_id", "lang"),
                          table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("j2_left_fill", """SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def j2(spark, d):
    return joins.left_fill(table(spark, d, "documents").select("doc_id"),
                           table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], {"quality": -1})


@query("j3_join_unique", """WITH one AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1)
  SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN one ON o_custkey = c_custkey""")
def j3(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = joins.join_unique(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"],
                               ["o_orderdate", "o_orderkey"])
    return joined.select("c_custkey", "o_orderkey", "o_totalprice")


@query("j4_keys_in", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j4_in(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1")
    return joins.keys_in(table(spark, d, "documents").select("doc_id"), toxic, ["doc_id"])


@query("j4_keys_not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4_not_in(spark, d):
    return joins.keys_not_in(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


FREQ = f"""{EV}, freq AS (SELECT grp, position, ref_char, var_char, count(*) AS count,
  any_value(n_rows) AS n_rows, count(*) / any_value(n_rows) AS frequency FROM ev
  JOIN (SELECT grp, count(*) AS n_rows FROM ords GROUP BY grp) USING (grp) GROUP BY ALL)"""


@query("j5_shared_keys", f"""WITH {FREQ} SELECT a.position, a.var_char, {R('a.f', 'frequency_a')}, {R('b.f', 'frequency_b')},
    {R('a.f + b.f', 'combined_frequency')}
  FROM (SELECT position, var_char, sum(frequency) AS f FROM freq WHERE grp = '1-URGENT' GROUP BY 1, 2) a
  JOIN (SELECT position, var_char, sum(frequency) AS f FROM freq WHERE grp = '5-LOW' GROUP BY 1, 2) b
  ON a.position = b.position AND a.var_char = b.var_char""")
def j5(spark, d):
    records, _, ev = order_events(spark, d)
    return rounded(joins.shared_keys(variant_frequency(ev, records), "1-URGENT", "5-LOW", ["position", "var_char"]))


@query("j6_ordinal_pairs", f"""WITH s AS (SELECT l_shipmonth AS name, row_number() OVER (ORDER BY l_shipmonth) AS ordinal, q
    FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, avg(l_quantity) AS q FROM lineitem GROUP BY 1)),
  ext AS (SELECT a.name AS a, b.name AS b, abs(a.q - b.q) AS distance FROM s a JOIN s b ON b.ordinal = a.ordinal + 1)
  SELECT x.name AS a, y.name AS b, x.ordinal AS ordinal_a, y.ordinal AS ordinal_b, y.ordinal - x.ordinal AS steps,
    {R('distance')} FROM s x JOIN s y ON x.ordinal < y.ordinal AND y.ordinal <= x.ordinal + 12 LEFT JOIN ext ON ext.a = x.name AND ext.b = y.name""")
def j6(spark, d):
    from pyspark.sql import Window

    months = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("name")).agg(
        F.avg("l_quantity").alias("q"))
    w = Window.orderBy("name")  # one row per month
    s = months.withColumn("ordinal", F.row_number().over(w).cast("long")).withColumn("prev", F.lag("name").over(w))
    s = s.withColumn("prev_q", F.lag("q").over(w))
    ext = s.where("prev IS NOT NULL").select(
        F.col("name").alias("a"), F.col("prev").alias("b"), F.abs(F.col("q") - F.col("prev_q")).alias("distance"))
    return rounded(joins.ordinal_pairs(s.select("name", "ordinal"), ext, 12))


@query("j7_pre_post", f"""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_totalprice AS v FROM orders),
  e(event, t) AS (VALUES ('one', 1996), ('two', 1999), ('none', 2050))
  SELECT event, CAST(t AS INTEGER) AS t, {R('avg(v) FILTER (WHERE period < t)', 'pre_mean')},
    {R('avg(v) FILTER (WHERE period >= t)', 'post_mean')}, count(v) FILTER (WHERE period < t) AS n_pre,
    count(v) FILTER (WHERE period >= t) AS n_post
  FROM e LEFT JOIN o ON period >= t - 2 AND period < t + 2 GROUP BY event, t""")
def j7(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_totalprice").alias("v"))
    events = spark.createDataFrame([("one", 1996), ("two", 1999), ("none", 2050)], "event string, t int")
    return rounded(joins.pre_post(rows, events, 2, "v"))


@query("j8_union_like", """SELECT c_custkey AS party, c_acctbal AS balance, 'customer' AS kind FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""")
def j8(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit("supplier").alias("kind"))
    return joins.union_like([c, s], [{"c_custkey": "party", "c_acctbal": "balance"},
                                     {"s_suppkey": "party", "s_acctbal": "balance"}])
