"""Name -> (query, equivalent SQL) registry and the views both sides start from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.labels import label_intervals
from faultlens.session import checkpoint_dir


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


# Closed failure intervals inside the month the test events cover.
INTERVALS = (
    ("2024-01-05 00:00:00", "2024-01-06 12:00:00"),
    ("2024-01-06 00:00:00", "2024-01-07 00:00:00"),
    ("2024-01-20 10:00:00", "2024-01-22 14:30:00"),
)
AS_OF = "2024-01-30"

IN_INTERVAL_SQL = " OR ".join(
    f"ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in INTERVALS
)

# r: readings of one sensor pair per asset. s: the twelve sensors. l: s with a label.
R_SQL = """r AS (
  SELECT event_id, ts, user_id AS asset_id, event_type, value, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         least(1.0, round(value / 500, 6)) AS score
  FROM events)"""
S_SQL = (
    R_SQL
    + """,
s AS (
  SELECT event_id, ts, asset_id, event_type, score,
         value AS TP2, k AS TP3, value + k AS H1, value - k AS DV_pressure, 2 * k AS Reservoirs,
         2 * value AS Motor_current, k + hour(ts) AS Oil_temperature,
         CAST(event_type = 'click' AS DOUBLE) AS COMP, CAST(event_type = 'view' AS DOUBLE) AS DV_eletric,
         CAST(event_type = 'purchase' AS DOUBLE) AS Towers, CAST(event_type = 'signup' AS DOUBLE) AS MPG,
         CAST(event_type = 'error' AS DOUBLE) AS Oil_level
  FROM r)"""
)
L_SQL = S_SQL + f""",
l AS (SELECT *, CASE WHEN {IN_INTERVAL_SQL} THEN 1 ELSE 0 END AS anomaly FROM s)"""
# log: maintenance events; severity follows the risk band of the score.
RISK_SQL = "CASE WHEN score < 0.30 THEN 'NORMAL' WHEN score < 0.65 THEN 'ALERTA' ELSE 'CRÍTICO' END"
LOG_SQL = (
    R_SQL
    + f""",
log AS (
  SELECT event_id, ts, 'asset-' || asset_id AS equipment, event_type AS type, {RISK_SQL} AS severity,
         CAST(CAST(k AS INTEGER) AS VARCHAR) || 'min' AS duration, props AS description
  FROM r)"""
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return to_readings(table(spark, sf, "events"))


def to_readings(events: DataFrame) -> DataFrame:
    """Readings from the event table or an event stream."""
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("asset_id"),
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.least(F.lit(1.0), F.round(F.col("value") / 500, 6)).alias("score"),
    )


def sensors(spark: SparkSession, sf: str) -> DataFrame:
    return to_sensors(readings(spark, sf))


def to_sensors(rows: DataFrame) -> DataFrame:
    def is_type(name: str) -> Column:
        return (F.col("event_type") == name).cast("double")

    v, k = F.col("value"), F.col("k")
    return rows.select(
        "event_id",
        "ts",
        "asset_id",
        "event_type",
        "score",
        v.alias("TP2"),
        k.alias("TP3"),
        (v + k).alias("H1"),
        (v - k).alias("DV_pressure"),
        (2 * k).alias("Reservoirs"),
        (2 * v).alias("Motor_current"),
        (k + F.hour("ts")).alias("Oil_temperature"),
        is_type("click").alias("COMP"),
        is_type("view").alias("DV_eletric"),
        is_type("purchase").alias("Towers"),
        is_type("signup").alias("MPG"),
        is_type("error").alias("Oil_level"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return label_intervals(sensors(spark, sf), INTERVALS, kind="int")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    from faultlens.functions.scalar import risk_level

    return readings(spark, sf).select(
        "event_id",
        "ts",
        F.concat(F.lit("asset-"), F.col("asset_id").cast("string")).alias("equipment"),
        F.col("event_type").alias("type"),
        risk_level("score").alias("severity"),
        F.concat(F.col("k").cast("int").cast("string"), F.lit("min")).alias("duration"),
        F.col("props").alias("description"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def r6(c: str | Column) -> Column:
    return F.round(c, 6)
