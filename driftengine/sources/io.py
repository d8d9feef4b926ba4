"""Readers and writers: delimited tables, FASTA text, manifests and content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(
    spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "csv",
    sep: str = ",",
) -> DataFrame:
    """Delimited text, JSON or parquet with a declared schema (no inference pass)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else sep)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def resolve_column(df: DataFrame, name: str) -> Column:
    """Column by case-insensitive, trimmed name."""
    for c in df.columns:
        if c.strip().lower() == name.strip().lower():
            return F.col(f"`{c}`")
    raise KeyError(name)


def parse_fasta(text: DataFrame) -> DataFrame:
    """Records from chunks of text that begin with a ``>`` mark or after it: ``id, period, place,
    sequence``. Further marks in a header belong to it."""
    text = text.select(F.regexp_replace("value", "^\\s*>", "").alias("value"))
    header = F.regexp_replace(F.split(F.col("value"), "\n", 2)[0], "\r$", "")
    rest = F.expr("substring(value, instr(value, '\n') + 1)")
    rest = F.when(F.instr("value", "\n") > 0, rest).otherwise(F.lit(""))
    parts = F.split(F.trim(header), "\\|")
    return text.where(F.trim("value") != "").select(
        F.trim(F.get(parts, 0)).alias("id"),
        F.get(parts, 1).try_cast("int").alias("period"),
        F.get(parts, 2).alias("place"),
        F.regexp_replace(rest, "\\s", "").alias("sequence"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files, records split in parallel by ``>`` at the beginning of a line."""
    return parse_fasta(spark.read.text(path, lineSep="\n>"))


def fasta_lines(df: DataFrame, header_cols: Sequence[str], width: int = 70, seq: str = "sequence"):
    """One text value per record: header, then lines of ``width`` symbols. Spaces, line breaks and
    the marks of the format (``|``, ``>``) become ``_`` in header fields."""
    fields = [
        F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[ |>\r\n]", "_")
        for c in header_cols
    ]
    header = F.concat(F.lit(">"), F.concat_ws("|", *fields))
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat_ws("\n", header, wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, header_cols: Sequence[str], width: int = 70) -> None:
    fasta_lines(df, header_cols, width).write.mode("errorifexists").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", cols: Sequence[str] | None = None) -> None:
    """CSV, TSV, JSON or parquet with chosen columns."""
    out = df.select(*cols) if cols else df
    writer = out.write.mode("errorifexists")
    if fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        writer.format(fmt).save(path)


def overlay(base: DataFrame, patch: DataFrame, key: Sequence[str], where: Column) -> DataFrame:
    """Rows of ``patch`` replace rows of ``base`` with the same key where ``where`` holds.

    Everything else of ``base`` stays; all patch rows are added.
    """
    keys = patch.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    hit = F.coalesce(where, F.lit(False))
    for k in key:
        hit = hit & (F.col(k) == F.col(f"__{k}"))
    return base.join(keys, hit, "left_anti").unionByName(patch.select(*base.columns))


def attach_metadata(seqs: DataFrame, meta: DataFrame, key: str, seq: str = "sequence") -> DataFrame:
    """Metadata joined back to parsed sequences, length recomputed."""
    return seqs.join(meta.drop(seq, "length"), key).withColumn("length", F.length(seq))


def manifest(df: DataFrame, key: str, source: str, url_prefix: str, digits: int = 16) -> DataFrame:
    """Unique keys with source, URL and a short SHA-256 of the key."""
    keys = df.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    return keys.select(
        "key",
        F.lit(source).alias("source"),
        F.concat(F.lit(url_prefix), "key").alias("url"),
        F.substring(F.sha2("key", 256), 1, digits).alias("sha256_short"),
    )


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count and 64-bit XOR and sum of row hashes."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    digest = F.sha2(row, 256)
    word = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    other = F.conv(F.substring(digest, 16, 15), 16, 10).cast("decimal(20,0)")
    return df.select(word.alias("w"), other.alias("o")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("w").alias("xor_hash"),
        F.sum("o").cast("string").alias("sum_hash"),
    )
