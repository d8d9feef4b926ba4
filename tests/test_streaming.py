"""Streams against their batch twins: late and boundary rows, restarts, baselines."""

import datetime as dt
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from driftengine.streaming import monitor

SCHEMA = "entity string, ts timestamp, metric double, kind string"
T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def write(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_monitor_drops_late_rows_and_matches_batch(spark, tmp_path):
    path = str(tmp_path)
    first = [("a", at(h), float(h), "error" if h % 5 == 0 else "ok") for h in range(30)] + [("b", at(24), 1.0, "ok")]
    late = [("a", at(1), 999.0, "ok"), ("a", at(72), 1.0, "ok")]
    base = monitor.baseline_table(spark.createDataFrame(first, SCHEMA))
    write(spark, path, "1", first)

    def run(name):
        out = monitor.stream_monitor(stream(spark, path), base)
        q = (out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/out"))
        q.awaitTermination()

    run("one")
    write(spark, path, "2", late)
    run("two")
    got = spark.read.parquet(f"{path}/out").withColumn("d", F.dayofmonth("window_start"))
    on_time = spark.createDataFrame(first, SCHEMA)
    twin = monitor.score_windows(monitor.window_metrics(on_time), base).withColumn("d", F.dayofmonth("window_start"))
    cols = ["entity", "d", "n", "mean_metric", "error_share", "distance", "alert_level"]
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    assert key(got) == key(twin)
    # The boundary row at hour 24 belongs to the second day.
    assert {(r.entity, r.d, r.n) for r in got.collect()} == {("a", 1, 24), ("a", 2, 6), ("b", 2, 1)}


def test_sliding_windows(spark):
    rows = [("a", at(1), 1.0, "ok"), ("a", at(13), 3.0, "ok")]
    got = monitor.window_metrics(spark.createDataFrame(rows, SCHEMA), "1 day", "12 hours").collect()
    assert sorted((r.window_start, r.n, r.mean_metric) for r in got) == [
        (at(-12), 1, 1.0), (at(0), 2, 2.0), (at(12), 1, 3.0)]


def run_self_baseline(spark, path, **options):
    with monitor.rocksdb_state(spark):
        out = monitor.stream_self_baseline(stream(spark, path), **options)
        (out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/out").awaitTermination())


def test_self_baseline_survives_a_restart(spark, tmp_path):
    path = str(tmp_path)
    days = [[("a", at(24 * d + h), float(d), "ok") for h in range(3)] + [("b", at(24 * d), 5.0 + d, "error")] for d in range(4)]
    for d, rows in enumerate(days):
        write(spark, path, str(d), rows)
        run_self_baseline(spark, path)
    got = spark.read.parquet(f"{path}/out")
    closed = spark.createDataFrame([r for rows in days[:3] for r in rows], SCHEMA)
    twin = monitor.self_baseline(monitor.window_metrics(closed))
    cols = ["entity", "window_start", "n", "distance", "drift"]
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(got) == key(twin)
    assert {(r.entity, r.distance) for r in got.collect()} == {("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 0.0), ("b", 1.0), ("b", 2.0)}


def test_self_baseline_keeps_one_state_row_an_entity(spark, tmp_path):
    """Many micro-batches, new entities in each: state has one row an entity, whatever the batches."""
    path, n = str(tmp_path), 12
    for d in range(n):
        write(spark, path, str(d), [(f"e{k}", at(24 * d), float(d - k), "ok") for k in range(d + 1)])
    run_self_baseline(spark, path)
    got = spark.read.parquet(f"{path}/out").collect()
    # The last two days are open, as the watermark is an hour behind; an entity's first window is the day it appears.
    assert sorted((r.entity, r.distance) for r in got) == sorted((f"e{k}", float(d - k)) for d in range(n - 2) for k in range(d + 1))
    state = spark.read.format("state-metadata").load(f"{path}/checkpoint")
    assert state.where("operatorName like 'transformWithState%'").count() > 0


def test_self_baseline_with_null_metric(spark, tmp_path):
    path = str(tmp_path)
    write(spark, path, "1", [("a", at(0), None, "ok"), ("a", at(24), 1.0, "ok"), ("a", at(48), 1.0, "ok"),
                             (None, at(0), 2.0, "ok"), (None, at(24), 5.0, "ok")])
    write(spark, path, "2", [("z", at(96), 0.0, "ok")])
    run_self_baseline(spark, path)
    got = {(r.entity, r.window_start): (r.distance, r.drift) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got["a", at(24)] == (None, None) and got[None, at(0)] == (0.0, 0) and got[None, at(24)] == (3.0, 1)


def test_self_baseline_without_its_state_store_is_an_error(spark, tmp_path):
    path = str(tmp_path)
    write(spark, path, "1", [("a", at(0), 1.0, "ok"), ("a", at(72), 1.0, "ok")])
    query = (monitor.stream_self_baseline(stream(spark, path)).writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/out"))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()


def test_self_baseline_forgets_after_its_time(spark, tmp_path):
    path = str(tmp_path)
    write(spark, path, "0", [("a", at(0), 1.0, "ok")])
    out = monitor.stream_self_baseline(stream(spark, path), ttl_ms=1)
    with monitor.rocksdb_state(spark):
        query = (out.writeStream.format("memory").queryName("forgetful").trigger(processingTime="1 second")
                 .option("checkpointLocation", f"{path}/checkpoint").start())
    try:
        for d in (1, 2, 3):  # each closes the day before, long after its baseline has gone
            write(spark, path, str(d), [("a", at(24 * d + 2), 1.0 + d, "ok")])
            for _ in range(40):
                if spark.table("forgetful").count() >= d:
                    break
                time.sleep(0.5)
        got = [r.distance for r in spark.table("forgetful").collect()]
    finally:
        query.stop()
    assert got == [0.0, 0.0, 0.0]
