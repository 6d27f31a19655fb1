from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions.scalar import risk_level
from faultlens.operators import fleet as G
from faultlens.queries.registry import L_SQL, R_SQL, RISK_SQL, labelled, query, r6, readings, table
from faultlens.schema import SENSORS

LATEST_SQL = R_SQL + f""",
latest AS (SELECT asset_id, event_id, ts, score AS probability, {RISK_SQL} AS risk FROM r
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) = 1)"""


def latest(spark, sf):
    rows = readings(spark, sf).select(
        "asset_id", "event_id", "ts", F.col("score").alias("probability"), risk_level("score").alias("risk")
    )
    return G.latest_per_asset(rows, ["event_id", "ts", "probability", "risk"])


@query("latest_per_asset", f"WITH {LATEST_SQL} SELECT * FROM latest")
def latest_per_asset(spark, sf):
    return latest(spark, sf)


@query(
    "effective_risk",
    f"""WITH {LATEST_SQL}, a AS (SELECT asset_id, max(score) AS m FROM r WHERE score > 0.5 GROUP BY asset_id),
    e AS (SELECT l.asset_id, probability, coalesce(m, 0) AS alert_probability,
      greatest(probability, coalesce(m, 0)) AS score FROM latest l LEFT JOIN a USING (asset_id))
    SELECT asset_id, probability, alert_probability, score AS effective_probability, {RISK_SQL} AS risk FROM e""",
)
def effective_risk(spark, sf):
    alerts = readings(spark, sf).where("score > 0.5").select("asset_id", F.col("score").alias("probability"))
    return G.effective_risk(latest(spark, sf).select("asset_id", "probability"), alerts)


@query(
    "max_alert_probability",
    f"WITH {R_SQL} SELECT coalesce(max(score), 0.0) AS max_probability FROM r WHERE score > 0.7",
)
def max_alert_probability(spark, sf):
    alerts = readings(spark, sf).where("score > 0.7").select(F.col("score").alias("probability"))
    return G.max_alert(alerts)


@query(
    "fleet_kpis",
    f"""WITH {LATEST_SQL} SELECT count(*) AS assets, count(*) FILTER (risk <> 'NORMAL') AS at_risk,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 8 HOUR) AS online FROM latest""",
)
def fleet_kpis(spark, sf):
    return G.fleet_kpis(latest(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), "8 HOURS")


@query(
    "alert_rows",
    f"""WITH {R_SQL} SELECT 'alert' AS type, md5(asset_id || '|' || epoch_us(ts)) AS message_id,
    strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, score AS probability,
    CAST(score >= 0.5 AS INTEGER) AS predicted_class, CAST(asset_id AS VARCHAR) AS sensor_id, true AS triggered
    FROM r WHERE score > 0.70""",
)
def alert_rows(spark, sf):
    return G.alert_rows(readings(spark, sf), probability="score")


@query(
    "healthy_profile",
    f"""WITH {L_SQL} SELECT unnest([{", ".join(f"'{c}'" for c in SENSORS)}]) AS sensor,
    round(unnest([{", ".join(f"quantile_cont({c}, 0.5)" for c in SENSORS)}]), 6) AS median
    FROM l WHERE anomaly = 0""",
)
def healthy_profile(spark, sf):
    out = G.healthy_profile(labelled(spark, sf), SENSORS)
    return out.select("sensor", r6("median").alias("median"))


@query(
    "duty_cycle",
    """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS load, sum(round(l_tax * 100)) AS idle
      FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS n_days,
      round(avg(CASE WHEN load + idle = 0 THEN 0 ELSE load / (load + idle) END) * 100, 0) AS efficiency
    FROM d GROUP BY l_suppkey""",
)
def duty_cycle(spark, sf):
    days = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("day"))
        .agg(F.sum("l_quantity").alias("load"), F.sum(F.round(F.col("l_tax") * 100)).alias("idle"))
    )
    return G.duty_cycle(days, "l_suppkey", "load", "idle")
