"""Exact deduplication with an extendible-hash index on shared files (DataFrame functions only).

The key of a text is its 64-bit hash; the directory is indexed by the key's leading bits. A bucket
that would hold more than ``capacity`` entries is split by looking at one bit more, so the directory
doubles until every bucket fits. Owner tasks hold contiguous ranges of the directory; in a bucket,
entries with equal keys form a chain, and an entry is one distinct text, told apart by its bytes.
Copies are counted before they are shuffled, so a text that makes up a third of all rows is one
entry with one row per map task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.llm.common import SPACE, shared_path, stored

#: Entries (distinct texts) of a bucket before it is split.
CAPACITY = 16_384


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


@dataclass(frozen=True)
class HashIndex:
    """``directory``: prefix, depth, bucket, entries. ``entries``: owner, bucket, depth, key, chain,
    chain_length, sha256, keep_id, group_size, on files sorted by key range."""

    directory: DataFrame
    entries: DataFrame
    bits: int


def build_index(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id",
                text_col: str = "text") -> HashIndex:
    """Index every distinct normalised text of ``docs`` with its smallest id and its copies."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    # Grouping by key and text compares bytes whenever keys are equal.
    found = text.groupBy(F.xxhash64("text").alias("key"), "text").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = stored(found.select("key", F.sha2("text", 256).alias("sha256"), "keep_id", "group_size"),
                   "entries")

    # Bits that leave about 1/16 of the capacity in a slot: a small table, whatever the input.
    bits = 1 + max(0, math.ceil(math.log2(16 * max(1, found.count()) / capacity)))
    slot = F.shiftrightunsigned("key", 64 - bits)
    fine = found.groupBy(slot.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    # Every doubling of the directory at once: a slot belongs to one bucket at each depth, and
    # its bucket is the shallowest one that is not overfull.
    levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    at_depth = F.expr(f"shiftrightunsigned(prefix, {bits} - depth)")
    levels = levels.withColumn("bucket", at_depth)
    filled = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("entries"))
    fits = (F.col("entries") <= capacity) | (F.col("depth") == bits)
    best = levels.join(filled.where(fits), ["depth", "bucket"]).groupBy("prefix").agg(
        F.min(F.struct("depth", "bucket", "entries")).alias("b"))
    directory = stored(best.select("prefix", "b.*"), "directory")

    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(F.col("prefix") * owners / F.lit(1 << bits)).cast("int")
    placed = found.withColumn("prefix", slot).join(directory.drop("entries"), "prefix")
    chain = Window.partitionBy("key").orderBy("sha256")  # distinct texts with one 64-bit key
    entries = placed.select(
        owner.alias("owner"), "depth", "bucket", "key",
        (F.row_number().over(chain) - 1).alias("chain"),
        F.count(F.lit(1)).over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("chain_length"), "sha256", "keep_id", "group_size")
    path = shared_path(spark, "index")
    entries.repartition(owners, "owner").sortWithinPartitions("owner", "bucket", "key", "chain") \
        .write.parquet(path)
    return HashIndex(directory, spark.read.schema(entries.schema).parquet(path), bits)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (all its columns) with keep_id, group_size, kept and text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest id is kept; null ids are
    never the smallest unless a group has no other (then keep_id is null and none is kept). Rows
    that repeat both id and text are all kept, they are one document. Own columns of these names
    are replaced. An empty table gives no rows.
    """
    index = build_index(docs, capacity, id_col, text_col)
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    plain = normalised(F.col(text_col))
    rows = docs.select(*own, F.xxhash64(plain).alias("__key"), F.sha2(plain, 256).alias("text_sha256"))
    entries = index.entries.select(
        F.col("key").alias("__key"), F.col("sha256").alias("text_sha256"), "keep_id", "group_size")
    return rows.join(entries, ["__key", "text_sha256"], "left").select(
        *own, "keep_id", "group_size",
        F.coalesce(F.col(id_col) == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return exact_groups(docs.select("doc_id", "text", row), capacity).where("kept").select("row.*")
