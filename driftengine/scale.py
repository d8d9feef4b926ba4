"""Building blocks that keep the operators safe on large, skewed tables.

* ``materialize``     cut lineage through the shared checkpoint folder
* ``written``         the same, as Parquet: smaller for long rows, and read in splits of its own size
* ``dim_join``        broadcast a lookup side only after measuring it, shuffle otherwise
* ``range_join``      interval lookup as an equi-join on segments of the value axis
* ``running_totals``  exact cumulative sums per group without a one-task window
* ``hash_rank``       exact, reproducible random order per group, split into buckets
* ``exact_quantiles`` exact interpolated quantiles from running counts
* ``spread``          use all cores when a small file comes in one split
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and is not larger than this.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 << 20
#: Cut points of the value axis in an interval lookup.
SEGMENTS = 50_000
#: Rows one window task should see in running totals; sets the number of value buckets.
BUCKET_ROWS = 500_000
#: Only tables of fewer splits (128 MB each at most, by default) may be spread by a shuffle.
SPREAD_SPLITS = 16
#: Leading hex digits of a hash that form a bucket: 65,536 buckets per group.
HASH_DIGITS = 4


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's setting, or a local one in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="driftengine-")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in reliable storage, so losing executors is harmless."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Measure a table (rows and bytes); call it on materialized or raw small tables."""
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and b <= max_bytes


def dim_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    ready: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Join a large table with a lookup table that has one row per key.

    The lookup is materialized and measured. Small: broadcast, the large side never moves.
    Large: a shuffle join; AQE splits the partitions of hot keys by their measured sizes, equal
    rows too, against the key's one lookup row.
    """
    on = list(on)
    small = dim if ready else materialize(dim)
    if is_small(small, max_rows):
        return fact.join(F.broadcast(small), on, how)
    return fact.join(small, on, how)


def range_join(
    fact: DataFrame,
    value: str,
    dim: DataFrame,
    start: str = "start",
    end: str = "end",
    on: Sequence[str] = (),
    how: str = "left",
    max_rows: int | None = None,
) -> DataFrame:
    """Attach every interval ``[start, end)`` of ``dim`` that holds ``fact.value``.

    The starts and ends (or that many quantiles of them, beyond ``SEGMENTS``) cut the value axis into
    segments. A row knows its segment by binary search, an interval is listed in each segment it
    touches, and the lookup is an equi-join on (keys, segment), broadcast if the listed intervals
    are measured small. A wide interval does not widen the segments of the others, and a value that
    many rows share is split by AQE.
    """
    on = list(on)
    keep = [c for c in dim.columns if c not in on]
    d = dim.where(F.col(start) < F.col(end)).select(*[F.col(c).alias(f"__d_{c}") for c in on], *keep)
    points = d.select(F.explode(F.array(F.col(start).cast("double"), F.col(end).cast("double"))).alias("v"))
    points = points.where(F.col("v").isNotNull()).distinct()
    if points.count() <= SEGMENTS:
        cuts = sorted(r[0] for r in points.collect())  # SEGMENTS numbers at most
    else:
        cuts = points.stat.approxQuantile("v", [i / SEGMENTS for i in range(1, SEGMENTS)], 0.5 / SEGMENTS)
    left = _numbered(fact, value, cuts, "__segment")
    d = _numbered(_numbered(d, start, cuts, "__from"), end, cuts, "__to")
    d = d.withColumn("__dsegment", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")
    d = materialize(d)
    cond = [F.col(c) == F.col(f"__d_{c}") for c in on]
    cond += [F.col("__segment") == F.col("__dsegment")]
    cond += [F.col(value) >= F.col(start), F.col(value) < F.col(end)]
    all_of = cond[0]
    for c in cond[1:]:
        all_of = all_of & c
    out = left.join(F.broadcast(d) if is_small(d, max_rows) else d, all_of, how)
    return out.drop("__segment", "__dsegment", *[f"__d_{c}" for c in on])


def _numbered(df: DataFrame, col: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Number of the cut points at or below a numeric column; -1 for null. Without cut points, or
    with no finite one, all values are in one range."""
    as_double = df.withColumn("__v", F.col(col).cast("double"))
    splits = [float("-inf"), *sorted({float(c) for c in cuts if abs(c) != float("inf")}), float("inf")]
    if len(splits) < 3:
        number = F.when(F.col("__v").isNotNull(), 0)
        return as_double.withColumn(out, F.coalesce(number, F.lit(-1))).drop("__v")
    from pyspark.ml.feature import Bucketizer  # not at the top: workers import this module, and that one takes 30 MB

    bz = Bucketizer(splits=splits, inputCol="__v", outputCol=out, handleInvalid="keep")
    return bz.transform(as_double).drop("__v").withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1)))


def value_buckets(df: DataFrame, col: str, out: str = "__bucket", buckets: int | None = None):
    """Number the rows by ranges of a numeric column with about equal counts.

    Read several times, so pass a materialized table. The cut points come from one
    approximate-quantile pass (a bounded list of doubles): the bucket is a pure function of the
    value and a recomputed task gives the same answer.
    """
    if buckets is None:
        buckets = max(8, df.count() // BUCKET_ROWS)
    probs = [i / buckets for i in range(1, buckets)]
    as_double = df.select(F.col(col).cast("double").alias("v"))
    # No cut points for an empty or all-null column: everything is in one bucket. Nulls get
    # bucket -1, where they sort.
    return _numbered(df, col, as_double.stat.approxQuantile("v", probs, 0.5 / buckets), out)


def running_totals(
    df: DataFrame,
    order: str,
    cols: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    fn: str = "sum",
    buckets: int | None = None,
    ready: bool = False,
) -> DataFrame:
    """Inclusive running ``sum`` (or ``min``) of columns ``{column: output}`` per group.

    ``df`` has one row per (by, order value): aggregate ties first. Rows are split into value
    buckets; the window runs inside a bucket and gets the total of the earlier buckets added,
    so a group with a third of all rows is spread over many tasks.
    """
    by = list(by)
    agg = F.sum if fn == "sum" else F.min
    df = df if ready else materialize(df)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("g"))
    b = value_buckets(df, order, buckets=buckets).withColumn("__k", key)
    direction = lambda c: F.col(c).desc() if descending else F.col(c)

    # At most one row per (group, bucket).
    totals = b.groupBy("__k", "__bucket").agg(*[agg(c).alias(f"__t_{c}") for c in cols])
    before = Window.partitionBy("__k").orderBy(direction("__bucket"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__k", "__bucket", *[agg(f"__t_{c}").over(before).alias(f"__o_{c}") for c in cols]
    )

    inside = Window.partitionBy("__k", "__bucket").orderBy(direction(order))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[agg(c).over(inside).alias(f"__l_{c}") for c in cols])
    out = local.join(offsets, ["__k", "__bucket"])
    for c, name in cols.items():
        here, earlier = F.col(f"__l_{c}"), F.col(f"__o_{c}")
        both = here + F.coalesce(earlier, F.lit(0)) if fn == "sum" else F.least(here, earlier)
        out = out.withColumn(name, both)
    return out.drop("__k", "__bucket", *[f"__{p}_{c}" for p in "lo" for c in cols])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small scanned table over the cores if its files give only a few splits. Tables of
    more than ``SPREAD_SPLITS`` splits are never moved, however many cores there are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(slots, SPREAD_SPLITS):
        return df.repartition(2 * slots, *keys)
    return df


def in_parallel(fn: Callable, items: Sequence, threads: int = 4) -> list:
    """Run independent Spark jobs from a few driver threads; results in the order of items."""
    with ThreadPoolExecutor(threads) as pool:
        run = inheritable_thread_target(SparkSession.active())(fn)
        return list(pool.map(run, items))


def hash_order(key: str, seed: int = 42) -> Column:
    """Reproducible random order: md5 of ``key:seed``."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    seed: int = 42,
    quota: DataFrame | int | None = None,
    digits: int = HASH_DIGITS,
    rank: str = "rank",
    total: str = "total",
) -> DataFrame:
    """Exact 1-based rank of each row in the hash order of its group, and the group size.

    The leading hex digits of the hash are uniform buckets (65,536 for four digits): rank =
    rows in earlier buckets + rank inside the bucket, so no task sees a whole group. With a
    ``quota`` (a number, or a table ``by, quota``) buckets past the quota are dropped before
    anything is shuffled, and only rows with ``rank <= quota`` come back.
    """
    by = list(by)
    keyed = df.withColumn("__h", hash_order(key, seed))
    keyed = keyed.withColumn("__bucket", F.substring("__h", 1, digits))
    gk = F.struct(*by) if by else F.struct(F.lit(0).alias("g"))
    keyed = keyed.withColumn("__k", gk)
    per = keyed.groupBy("__k", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__k")
    before = w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "__k",
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(w).alias(total),
    )
    if quota is None:
        joined = keyed.join(per, ["__k", "__bucket"])
    else:
        if isinstance(quota, int):
            per = per.withColumn("__quota", F.lit(quota))
        else:
            q = quota.select(gk.alias("__k"), F.col("quota").alias("__quota"))
            per = per.join(q, "__k")
        per = per.where(F.col("__off") < F.col("__quota"))
        joined = dim_join(keyed, per, ["__k", "__bucket"])
    inside = Window.partitionBy("__k", "__bucket").orderBy("__h", key)
    out = joined.withColumn(rank, F.col("__off") + F.row_number().over(inside))
    if quota is not None:
        out = out.where(F.col(rank) <= F.col("__quota")).drop("__quota")
    return out.drop("__h", "__bucket", "__k", "__off")


def order_rank(
    df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = (), rank: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Exact 1-based position of each row in its group by a numeric column, ties by ``ties``.

    Like ``running_totals``: row numbers inside value buckets plus the rows of earlier buckets.
    """
    by = list(by)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("g"))
    b = value_buckets(materialize(df), order, buckets=buckets).withColumn("__k", key)
    per = b.groupBy("__k", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__k").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__k", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__k", "__bucket").orderBy(order, *ties)
    out = b.join(per, ["__k", "__bucket"])
    return out.withColumn(rank, F.col("__off") + F.row_number().over(inside)).drop(
        "__k", "__bucket", "__off")


def value_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per distinct ``value``: count ``n``, running count ``cum``, group size ``total``.

    ``weight`` names a count column if ``df`` is already counted.
    """
    by = list(by)
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    known = df.where(F.col(value).isNotNull())
    known = known.select(*by, F.col(value).alias("value"), n.alias("__w"))
    counts = materialize(known.groupBy(*by, "value").agg(F.sum("__w").alias("n")))
    cum = running_totals(counts, "value", {"n": "cum"}, by, ready=True)
    if by:
        total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        # Groups are compared as structs, which treats null groups as equal.
        k = F.struct(*by)
        return dim_join(
            cum.withColumn("__k", k), total.select(k.alias("__k"), "total"), ["__k"]).drop("__k")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return cum.join(F.broadcast(total))  # a global aggregate has exactly one row


def rank_join(df: DataFrame, value: str, ranks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Attach columns of a ``value_ranks`` table to every row by value.

    A value holding more than 1/1000 of all rows is hot; there can be at most 1000 of them, so
    they are broadcast. The other values have no skew and take a plain shuffle join.
    """
    hot_rule = F.lit(1000) * F.col("n") > F.col("total")
    r = materialize(ranks.select(F.col("value").alias(value), *cols, hot_rule.alias("__hot")))
    n_hot, n_cold = r.agg(F.count(F.when(F.col("__hot"), 1)), F.count(F.when(~F.col("__hot"), 1))).first()
    hot = F.broadcast(r.where("__hot").drop("__hot"))
    cold = r.where(~F.col("__hot")).drop("__hot")
    if n_cold == 0:
        return df.join(hot, value, "left")
    if n_hot == 0:
        return df.join(cold, value, "left")
    popular = df.join(hot, value)
    rest = df.join(hot.select(value), value, "left_anti").join(cold, value, "left")
    return popular.unionByName(rest)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles ``{output: probability}`` per group."""
    by = list(by)
    r = value_ranks(df, value, by, weight)
    first, last = F.col("cum") - F.col("n"), F.col("cum") - 1
    aggs = []
    v = F.col("value").cast("double")
    for name, q in probs.items():
        pos = F.lit(q) * (F.col("total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        frac = pos - lo
        at_lo = F.when((first <= lo) & (lo <= last), v * (1 - frac))
        at_hi = F.when((first <= hi) & (hi <= last), v * frac)
        aggs.append(
            (F.sum(F.coalesce(at_lo, F.lit(0.0)) + F.coalesce(at_hi, F.lit(0.0)))).alias(name)
        )
    return r.groupBy(*by).agg(*aggs)


def most_frequent(
    df: DataFrame, by: Sequence[str], value: str, out: str = "mode", n: str = "n_mode"
) -> DataFrame:
    """Most frequent value per group, smallest value on ties; two counting steps."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("m"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("__b")).select(
        *by, F.col("__b.v").alias(out), (-F.col("__b.m")).alias(n)
    )
