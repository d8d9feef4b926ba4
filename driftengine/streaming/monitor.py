"""Drift monitoring on Structured Streaming, with the batch twin of each computation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from driftengine.operators.monitor import alert_level
from driftengine.operators.stats import baseline_distance
from driftengine.scale import dim_join

METRICS = ["mean_metric", "error_share"]


def window_metrics(
    df: DataFrame, window: str = "1 day", slide: str | None = None, entity: str = "entity",
    error: Column | None = None,
) -> DataFrame:
    """Per window and entity: rows, mean metric and share of error rows. Batch and stream alike."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    bad = F.col("kind") == "error" if error is None else error
    return df.groupBy(span.alias("w"), entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("metric").alias("mean_metric"),
        F.avg(bad.cast("double")).alias("error_share"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             entity, "n", *METRICS)


def baseline_table(df: DataFrame, entity: str = "entity", error: Column | None = None) -> DataFrame:
    """Fixed baseline per entity from a reference batch."""
    bad = F.col("kind") == "error" if error is None else error
    return df.groupBy(entity).agg(
        F.avg("metric").alias("base_mean_metric"), F.stddev_pop("metric").alias("base_sd"),
        F.avg(bad.cast("double")).alias("base_error_share"))


def score_windows(windows: DataFrame, baseline: DataFrame, entity: str = "entity") -> DataFrame:
    """Distance of each window to the entity's baseline and its alert level.

    The metric gap is measured in baseline sds; distance is squashed to [0, 1) for the bands.
    """
    j = dim_join(windows, baseline, [entity]) if not windows.isStreaming else windows.join(baseline, entity)
    gap = (F.col("mean_metric") - F.col("base_mean_metric")) / F.greatest(F.col("base_sd"), F.lit(1e-9))
    share = F.col("error_share") - F.col("base_error_share")
    j = j.withColumn("distance", F.sqrt(gap * gap + share * share))
    j = j.withColumn("score", F.col("distance") / (F.lit(1.0) + F.col("distance")))
    return j.withColumn("alert_level", alert_level(F.col("score"))).drop(
        "base_mean_metric", "base_sd", "base_error_share")


def stream_monitor(
    sdf: DataFrame, baseline: DataFrame, window: str = "1 day", watermark: str = "1 hour",
    slide: str | None = None, entity: str = "entity", error: Column | None = None,
) -> DataFrame:
    """Windowed drift scores of a stream of ``entity, ts, metric, kind`` against a fixed baseline.

    Rows later than the watermark are dropped; a window is emitted once, when it closes.
    """
    late = sdf.withWatermark("ts", watermark)
    return score_windows(window_metrics(late, window, slide, entity, error), baseline, entity)


def self_baseline(windows: DataFrame, threshold: float = 0.15, entity: str = "entity") -> DataFrame:
    """Batch twin of ``stream_self_baseline``: distance of each window to the entity's first one."""
    return baseline_distance(windows, [entity], "window_start", METRICS, threshold)


class _FirstWindow(StatefulProcessor):
    """Keeps an entity's first closed window and measures the later ones against it."""

    def __init__(self, entity: str, threshold: float, ttl_ms: int | None):
        self.entity, self.threshold, self.ttl_ms = entity, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = ", ".join(f"{m} double" for m in METRICS)
        self.first = handle.getValueState("first", schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One row a window that closed in this micro-batch, in any order.
        closed = pd.concat(list(rows)).sort_values("window_start")
        metrics = closed[METRICS].astype(float).to_numpy(float, na_value=np.nan)
        if not self.first.exists():
            self.first.update(tuple(None if np.isnan(v) else float(v) for v in metrics[0]))
        base = np.array([np.nan if v is None else v for v in self.first.get()], float)
        closed["distance"] = np.sqrt(((metrics - base) ** 2).sum(axis=1))
        closed["drift"] = (closed["distance"] > self.threshold).astype("int32").where(closed["distance"].notna(), None)
        closed["distance"] = closed["distance"].astype(object).where(closed["distance"].notna(), None)
        yield closed

    def close(self) -> None:
        pass


def stream_self_baseline(
    sdf: DataFrame, window: str = "1 day", watermark: str = "1 hour", threshold: float = 0.15,
    entity: str = "entity", error: Column | None = None, ttl_ms: int | None = None,
) -> DataFrame:
    """Distance of every closed window to the entity's first one, as a stream in append mode.

    Windows are aggregated first, so a busy entity sends one row per window. The first window is a
    keyed value in the state store (RocksDB, which the session has to be set to; see
    ``rocksdb_state``): a micro-batch reads and writes only the entities it holds, however many came
    before it, and a restart goes on from the query's checkpoint. Null metrics give a null distance.

    With ``ttl_ms`` an entity that was given its baseline longer ago than that (processing time) takes
    its next window as a new one. Such a query looks at the clock after every micro-batch, so it needs
    a trigger that does not wait for the end of the input (not ``availableNow``).
    """
    closed = window_metrics(sdf.withWatermark("ts", watermark), window, None, entity, error)
    schema = StructType([*closed.schema.fields, StructField("distance", DoubleType()), StructField("drift", IntegerType())])
    return closed.groupBy(entity).transformWithStateInPandas(
        statefulProcessor=_FirstWindow(entity, threshold, ttl_ms), outputStructType=schema,
        outputMode="append", timeMode="none" if ttl_ms is None else "processingTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as ``stream_self_baseline`` needs."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
