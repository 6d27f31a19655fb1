"""Numbers of the fleet overview, from the newest state of every asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.scalar import (
    ALERT_THRESHOLD,
    CEILINGS,
    NORMAL,
    alert_id,
    capacity_percent,
    iso_text,
    risk_level,
)
from faultlens.plans.quantiles import exact_percentiles


def latest_per_asset(
    df: DataFrame, columns: Sequence[str], key: str = "asset_id", order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Newest row per asset as a map-side combined aggregate: no sort, no hot task."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(newest.alias("_s")).select(key, "_s.*")


def effective_risk(latest: DataFrame, alerts: DataFrame, key: str = "asset_id") -> DataFrame:
    """Newest probability or highest open alert, whichever is larger, with its band."""
    peaks = alerts.groupBy(key).agg(F.max("probability").alias("alert_probability"))
    p = F.greatest(F.coalesce("probability", F.lit(0.0)), F.coalesce("alert_probability", F.lit(0.0)))
    return (
        latest.join(peaks, key, "left")
        .withColumn("alert_probability", F.coalesce("alert_probability", F.lit(0.0)))
        .withColumn("effective_probability", p)
        .withColumn("risk", risk_level("effective_probability"))
    )


def max_alert(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.coalesce(F.max("probability"), F.lit(0.0)).alias("max_probability"))


def fleet_kpis(latest: DataFrame, now: Column, online_within: str = "5 MINUTES") -> DataFrame:
    """Assets, assets not NORMAL, and assets heard of within the given time."""
    seen = F.col("ts") >= now - F.expr(f"INTERVAL {online_within}")
    return latest.agg(
        F.count("*").alias("assets"),
        F.count_if(F.col("risk") != NORMAL).alias("at_risk"),
        F.count_if(seen).alias("online"),
    )


def alert_rows(
    scored: DataFrame,
    threshold: float = ALERT_THRESHOLD,
    key: str = "asset_id",
    ts: str = "ts",
    probability: str = "probability",
) -> DataFrame:
    """One alert per row strictly above the threshold, with a replayable id."""
    return scored.where(F.col(probability) > threshold).select(
        F.lit("alert").alias("type"),
        alert_id(key, ts).alias("message_id"),
        iso_text(ts).alias("timestamp"),
        F.col(probability).alias("probability"),
        (F.col(probability) >= 0.5).cast("int").alias("predicted_class"),
        F.col(key).cast("string").alias("sensor_id"),
        F.lit(True).alias("triggered"),
    )


def capacity_profile(df: DataFrame, keep: Sequence[str], ceilings: dict[str, float] = CEILINGS) -> DataFrame:
    """Each sensor as a percentage of its ceiling, one row per sensor."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("sensor"), capacity_percent(name, top).alias("pct"))
            for name, top in ceilings.items()
        ]
    )
    return df.select(*keep, F.inline(cells))


def healthy_profile(df: DataFrame, sensors: Sequence[str], label: str = "anomaly") -> DataFrame:
    """Median of each sensor over healthy rows."""
    medians = exact_percentiles(df.where(F.col(label) == 0), sensors, [0.5])
    return df.sparkSession.createDataFrame(
        [(c, medians[c][0]) for c in sensors], "sensor string, median double"
    )


def duty_cycle(days: DataFrame, key: str, load: str, idle: str) -> DataFrame:
    """Mean of the daily load shares per asset, in whole percent."""
    share = F.coalesce(F.try_divide(F.col(load), F.col(load) + F.col(idle)), F.lit(0.0))
    return days.groupBy(key).agg(
        F.count("*").alias("n_days"), F.round(F.avg(share) * 100, 0).alias("efficiency")
    )
