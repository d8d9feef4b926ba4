"""Roles of the test tables: whole tables and whole texts, as records, events and series.

Each DataFrame builder has a SQL twin (a CTE body) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftengine.operators.sequence import diff_events, flag_region, modal_reference, to_sequence
from driftengine.scale import materialize, spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sequences: group = language, period = number of the source."""
    return spread(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("grp"),
        F.substring("source", 4, 10).cast("int").alias("period"),
        F.col("source").alias("place"),
        F.col("text").alias("sequence"),
    )


DOCS = """docs AS (SELECT doc_id AS id, lang AS grp, CAST(substr(source, 4) AS INTEGER) AS period,
  source AS place, text AS sequence FROM documents)"""


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as short sequences: one letter A..K per line for its discount step, in line order.

    Group = priority, period = year of the order.
    """
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.char(F.round(F.col("l_discount") * 100).cast("int") + 65).alias("symbol"),
    )
    seqs = to_sequence(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "symbol")
    orders = table(spark, d, "orders")
    return orders.join(seqs, orders.o_orderkey == seqs.l_orderkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        F.year("o_orderdate").alias("period"),
        F.col("o_orderstatus").alias("place"),
        "sequence",
    )


ORDS = """ords AS (SELECT o_orderkey AS id, o_orderpriority AS grp,
  CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus AS place, sequence
  FROM orders JOIN (SELECT l_orderkey, string_agg(symbol, '' ORDER BY l_linenumber, l_partkey,
    l_suppkey, symbol) AS sequence
    FROM (SELECT *, chr(CAST(round(l_discount * 100) AS INTEGER) + 65) AS symbol FROM lineitem)
    GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def modal_sql(src: str, where: str = "TRUE") -> str:
    """CTE ``refs``: modal sequence per group of ``src``, smallest digest on ties."""
    return f"""refs AS (SELECT grp, sequence AS ref, CAST(length(sequence) AS INTEGER) AS ref_length,
    n AS n_ref FROM (
    SELECT grp, sequence, count(*) AS n,
      row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, md5(sequence)) AS rk
    FROM {src} WHERE {where} GROUP BY grp, sequence) WHERE rk = 1)"""


def dist_sql(src: str) -> str:
    """CTE ``dist``: rows of ``src`` with their distance to ``refs``."""
    return f"""pairs AS (SELECT s.*, r.ref_length, least(length(s.sequence), r.ref_length) AS m,
    string_split(s.sequence, '') AS a, string_split(r.ref, '') AS b
    FROM {src} s JOIN refs r USING (grp)),
  dist AS (SELECT id, grp, period, place, sequence, ref_length, CASE WHEN m = 0 THEN 1.0 ELSE
    len(list_filter(list_zip(a[1:m], b[1:m]), lambda x: x[1] <> x[2])) / m END * ref_length AS distance
    FROM pairs)"""


def events_sql(src: str) -> str:
    """CTE ``ev``: position-difference events of ``src`` against ``refs``."""
    return f"""ev AS (SELECT id, grp, period, position, ref_char, var_char FROM (
    SELECT s.id, s.grp, s.period, CAST(g.i - 1 AS INTEGER) AS position,
      string_split(r.ref, '')[g.i] AS ref_char, string_split(s.sequence, '')[g.i] AS var_char
    FROM {src} s JOIN refs r USING (grp),
      LATERAL (SELECT unnest(range(1, least(length(s.sequence), r.ref_length) + 1)) AS i) g)
    WHERE ref_char <> var_char)"""


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ALPHABET = "ABCDEFGHIJK"


def order_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order records, their modal references (orders of four lines or more vote) and the
    differences from them."""
    records = materialize(order_records(spark, d))
    ref = materialize(modal_reference(records, where=F.length("sequence") >= 4))
    return records, ref, diff_events(records, ref)


EV = f"""{ORDS}, {modal_sql('ords', 'length(sequence) >= 4')},
  {events_sql('ords')}"""


def regions(spark: SparkSession) -> DataFrame:
    """Two position regions per priority, as a user would supply them."""
    rows = [(g, name, lo, hi) for g in PRIORITIES for name, lo, hi in (("head", 0, 1), ("mid", 2, 4))]
    return spark.createDataFrame(rows, "grp string, region string, start int, end int")


FLAGGED = f"""{EV}, fev AS (SELECT *, (position = 0 OR position IN (2, 3)) AS in_region FROM ev)"""


def flagged_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, ref, events = order_events(spark, d)
    return records, ref, flag_region(events, regions(spark))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scored rows: label = finished, prob = scaled price, three class probabilities."""
    prob = F.col("o_totalprice") / F.lit(499999.0)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        F.year("o_orderdate").alias("period"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        prob.alias("prob"),
        prob.alias("c0"),
        ((1 - prob) * F.lit(0.6)).alias("c1"),
        ((1 - prob) * F.lit(0.4)).alias("c2"),
    )


PREDS = """preds AS (SELECT o_orderkey AS id, o_orderpriority AS grp,
  CAST(year(o_orderdate) AS INTEGER) AS period,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice / 499999e0 AS prob,
  o_totalprice / 499999e0 AS c0, (1 - o_totalprice / 499999e0) * 6e-1 AS c1,
  (1 - o_totalprice / 499999e0) * 4e-1 AS c2 FROM orders)"""


def month_series(spark: SparkSession, d: str) -> DataFrame:
    """Orders per month and priority: count, mean price, finished share; period = month number."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grp"), month.alias("period"), "o_totalprice", "o_orderstatus"
    ).groupBy("grp", "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("o_totalprice").alias("mean_price"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("finished"),
    )


MONTHS = """months AS (SELECT o_orderpriority AS grp,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS period,
  count(*) AS n, avg(o_totalprice) AS mean_price,
  avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS finished
  FROM orders GROUP BY 1, 2)"""


def day_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric vector per event type and day: mean value, share of large values, users, events."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, d, "events").select(
        F.col("event_type").alias("entity"), day.alias("version"), "value", "user_id"
    ).groupBy("entity", "version").agg(
        (F.avg("value") / 100).alias("m1"),
        F.avg((F.col("value") > 50).cast("double")).alias("m2"),
        (F.stddev_pop("value") / 100).alias("m3"),
        F.count(F.lit(1)).alias("n"),
    )


DAYS = """days AS (SELECT event_type AS entity,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS version,
  avg(value) / 100 AS m1, avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END) AS m2,
  stddev_pop(value) / 100 AS m3, count(*) AS n FROM events GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zero."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def R(expr: str, name: str | None = None) -> str:
    """SQL twin of ``rounded`` for one column."""
    return f"round({expr}, 6) + 0e0 AS {name or expr}"
