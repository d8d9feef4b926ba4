"""Alert levels and status records, the same for batch tables and streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lower bound of each alert level.
BANDS = {"CRITICAL": 0.70, "WARNING": 0.50, "CAUTION": 0.30}

def alert_level(score: Column, bands: Mapping[str, float] = BANDS) -> Column:
    expr = F.lit("NORMAL")
    for name, low in sorted(bands.items(), key=lambda x: x[1]):
        expr = F.when(score >= low, F.lit(name)).otherwise(expr)
    return expr


def alert_levels(
    df: DataFrame, score: str, bands: Mapping[str, float] = BANDS, actions: Mapping[str, str] | None = None
) -> DataFrame:
    """Alert level of every row, and the caller's action text for it if given; works on streams."""
    df = df.withColumn("alert_level", alert_level(F.col(score), bands))
    if actions is None:
        return df
    action = F.lit(None).cast("string")
    for name, text in actions.items():
        action = F.when(F.col("alert_level") == name, F.lit(text)).otherwise(action)
    return df.withColumn("action", action)


def alerts(df: DataFrame, score: str, bands: Mapping[str, float] = BANDS) -> DataFrame:
    """Rows that reach the lowest band."""
    return alert_levels(df, score, bands).where(F.col(score) >= min(bands.values()))


def status_record(
    df: DataFrame, order: str, score: str, flags: Mapping[str, Column], risk: Column,
    by: Sequence[str] = (), recent: int = 3, forecast: DataFrame | None = None,
) -> DataFrame:
    """Newest row per entity as one status record, also as JSON.

    ``flags`` are precursor conditions on the newest row, ``risk`` marks rows at risk; those
    among the last ``recent`` rows are listed. Only bounded heads are aggregated, so a long
    history is never collected. ``forecast(by.., next_forecast)`` is attached if given.
    """
    by = list(by)
    named = df.withColumn("__risk", F.coalesce(risk, F.lit(False)))
    for name, cond in flags.items():
        named = named.withColumn(name, F.coalesce(cond, F.lit(False)))
    last = F.max(F.struct(order, score, *flags.keys())).alias("s")
    t = named.groupBy(*by).agg(last)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(order).desc())
    top = named.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= recent)
    listed = top.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("__risk"), F.col(order)))).alias("at_risk"))
    join = lambda a, b: a.join(b, by, "left") if by else a.join(F.broadcast(b))  # noqa: E731  one row
    out = join(t, listed)
    out = out.select(
        *by, F.col(f"s.{order}").alias("latest"), F.col(f"s.{score}").alias("drift_score"),
        *[F.col(f"s.{f}").alias(f) for f in flags], "at_risk")
    if forecast is not None:
        out = join(out, forecast)
    out = alert_levels(out, "drift_score").withColumnRenamed("alert_level", "status")
    fields = [c for c in out.columns if c not in by]
    return out.withColumn("record", F.to_json(F.struct(*fields)))
