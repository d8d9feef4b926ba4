"""One query per operator, over its whole table with production parameters, and its SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftengine.llm import (alignment, attribution, boilerplate, exact, jaccard, mixing, packing, quality, substring, topk,
                             toxicity, warc, whitening)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OTHER_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sources of the test tables are numbered; every third one belongs to one domain.
NUMBER = "coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0)"
LEVELS = {"domain": f"concat('domain', {NUMBER} % 3)", "lang": "lang", "source": "source"}
WEIGHTS = {
    "domain": "case domain when 'domain0' then 5 when 'domain1' then 3 else 2 end",
    "lang": "case lang when 'en' then 6 else 2 end",
    "source": f"{NUMBER} % 4 + 1",
}
EPOCHS = 2


def mixture(docs: DataFrame, budget: str = "total") -> DataFrame:
    return mixing.mix_sources(docs, LEVELS, WEIGHTS, budget, EPOCHS)


def _share_sql(level: str, path: str, weight: str, out: str, up: str) -> str:
    """CTEs for one level: ``up`` (path columns, given) to ``out`` (path and level, given)."""
    on = f"USING ({path})" if path else "ON TRUE"
    part = f"PARTITION BY {path}" if path else ""
    cols = f"{path}, {level}" if path else level
    return f"""{out}_a AS (SELECT {cols}, sum(tokens) * {EPOCHS} AS cap FROM leaves GROUP BY {cols}),
  {out}_b AS (SELECT {', '.join(f'a.{c.strip()}' for c in cols.split(','))}, cap, u.given AS budget,
    {weight} AS weight FROM {out}_a a JOIN {up} u {on}),
  {out}_c AS (SELECT *, budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
    FROM {out}_b WINDOW w AS ({part} ORDER BY cap::DOUBLE / weight, {level})),
  {out}_d AS (SELECT *, CAST(cap AS HUGEINT) * wl <= CAST(rest AS HUGEINT) * weight AS full_ FROM {out}_c),
  {out}_e AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({part}) AS lft,
    sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({part}) AS aw,
    sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({part} ORDER BY cap::DOUBLE / weight, {level}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {out}_d),
  {out} AS (SELECT {cols}, CAST(CASE WHEN full_ THEN cap ELSE (lft * upto) // aw - (lft * (upto - weight)) // aw END
    AS BIGINT) AS given FROM {out}_e)"""


_NUM = "coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0)"
MIXING_SQL = f"""WITH base AS (SELECT doc_id, 'domain' || ({_NUM} % 3) AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
  leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM base GROUP BY ALL),
  root AS (SELECT CAST(sum(tokens) AS BIGINT) AS given FROM leaves),
  {_share_sql('domain', '', "CASE domain WHEN 'domain0' THEN 5 WHEN 'domain1' THEN 3 ELSE 2 END", 'l1', 'root')},
  {_share_sql('lang', 'domain', "CASE lang WHEN 'en' THEN 6 ELSE 2 END", 'l2', 'l1')},
  {_share_sql('source', 'domain, lang', f"{_NUM} % 4 + 1", 'l3', 'l2')},
  b AS (SELECT leaves.*, given, CASE WHEN tokens = 0 THEN 0 ELSE given // tokens END AS full_epochs
    FROM leaves JOIN l3 USING (domain, lang, source)),
  k AS (SELECT base.*, b.full_epochs, b.given - b.full_epochs * b.tokens AS part,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('7:' || b.full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM base JOIN b USING (domain, lang, source)),
  p AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs,
    CAST(greatest(0, least(n_tokens, part - before)) AS BIGINT) AS prefix_tokens FROM k)
  SELECT *, full_epochs * n_tokens + prefix_tokens AS taken_tokens FROM p"""


@query("op2_source_mixing", MIXING_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


EXACT_SQL = """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x
    FROM documents),
  g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op4_exact_topk")
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, k=5)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op9_section_tokens")
def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


@query("op10_warc", WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "longest")


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query("op11_main_text")
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(table(spark, sf_dir, "pages"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, OTHER_TOKENIZER)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
