from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import scalar as S
from faultlens.queries.registry import LOG_SQL, R_SQL, RISK_SQL, S_SQL, event_log, query, r6, readings, sensors


@query("risk_level", f"WITH {R_SQL} SELECT event_id, {RISK_SQL} AS risk FROM r")
def risk_level(spark, sf):
    return readings(spark, sf).select("event_id", S.risk_level("score").alias("risk"))


@query(
    "risk_level_script",
    f"""WITH {R_SQL} SELECT event_id,
    CASE WHEN score < 0.30 THEN 'LOW' WHEN score < 0.70 THEN 'MÉDIO' ELSE 'CRÍTICO' END AS risk FROM r""",
)
def risk_level_script(spark, sf):
    return readings(spark, sf).select("event_id", S.risk_level("score", S.SCRIPT_BANDS).alias("risk"))


@query(
    "toast_severity",
    f"WITH {R_SQL} SELECT event_id, CASE WHEN score >= 0.65 THEN 'critical' ELSE 'warning' END AS severity FROM r",
)
def toast_severity(spark, sf):
    return readings(spark, sf).select("event_id", S.toast_severity("score").alias("severity"))


RAW_P = """CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE
  WHEN 3 THEN NULL WHEN 4 THEN -value WHEN 5 THEN value ELSE score END"""


def raw_probability():
    e = F.col("event_id") % 7
    return (
        F.when(e == 0, F.lit(float("nan")))
        .when(e == 1, F.lit(float("inf")))
        .when(e == 2, F.lit(float("-inf")))
        .when(e == 3, None)
        .when(e == 4, -F.col("value"))
        .when(e == 5, F.col("value"))
        .otherwise(F.col("score"))
    )


@query(
    "sanitize_probability",
    f"""WITH {R_SQL}, b AS (SELECT event_id, {RAW_P} AS p FROM r)
    SELECT event_id, CASE WHEN isfinite(p) THEN greatest(0.0, least(1.0, p)) END AS p FROM b""",
)
def sanitize_probability(spark, sf):
    return readings(spark, sf).select("event_id", S.sanitize_probability(raw_probability()).alias("p"))


@query(
    "finite_flags",
    f"""WITH {R_SQL}, b AS (SELECT event_id, {RAW_P} AS p FROM r)
    SELECT event_id, coalesce(isfinite(p), false) AS finite, coalesce(isnan(p), false) AS nan FROM b""",
)
def finite_flags(spark, sf):
    p = raw_probability()
    return readings(spark, sf).select(
        "event_id", S.is_finite(p).alias("finite"), F.coalesce(F.isnan(p), F.lit(False)).alias("nan")
    )


@query(
    "gauge_clamp",
    f"WITH {R_SQL} SELECT event_id, greatest(0.0, least(1.0, round((value - k) / 100, 6))) + 0.0 AS gauge FROM r",
)
def gauge_clamp(spark, sf):
    x = r6((F.col("value") - F.col("k")) / 100)
    return readings(spark, sf).select("event_id", S.clamp(x).alias("gauge"))


@query("class_decision", f"WITH {R_SQL} SELECT event_id, CAST(score >= 0.2 AS INTEGER) AS predicted_class FROM r")
def class_decision(spark, sf):
    return readings(spark, sf).select("event_id", S.decide("score", 0.2).alias("predicted_class"))


@query(
    "threshold_resolution",
    f"""WITH {R_SQL}, b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN NULL
      ELSE CAST(value / 50 AS VARCHAR) END AS raw, value FROM r)
    SELECT event_id, CASE WHEN event_id % 4 >= 2 AND value / 50 > 0 AND value / 50 < 1 THEN round(value / 50, 6)
      ELSE 0.5 END AS threshold FROM b""",
)
def threshold_resolution(spark, sf):
    e = F.col("event_id") % 4
    raw = F.when(e == 0, "bad").when(e >= 2, (F.col("value") / 50).cast("string"))
    return readings(spark, sf).select("event_id", r6(S.resolve_threshold(raw)).alias("threshold"))


@query(
    "capacity_profile",
    f"""WITH {S_SQL}, u AS (
      SELECT event_id, unnest(['TP2', 'TP3', 'H1', 'Motor_current', 'Oil_temperature', 'Reservoirs']) AS sensor,
        unnest([TP2 / 12, TP3 / 12, H1 / 12, Motor_current / 10, Oil_temperature / 80, Reservoirs / 12]) AS share FROM s)
    SELECT event_id, sensor, round(least(100.0, greatest(0.0, share * 100)), 1) AS pct FROM u""",
)
def capacity_profile(spark, sf):
    from faultlens.operators.fleet import capacity_profile as profile

    return profile(sensors(spark, sf), ["event_id"])


@query(
    "anomaly_sigmoid",
    f"""WITH {R_SQL} SELECT event_id, round(1 / (1 + exp(-((score - 0.3) / (0.3 / 3)))), 6) AS p FROM r""",
)
def anomaly_sigmoid(spark, sf):
    return readings(spark, sf).select("event_id", r6(S.anomaly_score("score", 0.3)).alias("p"))


@query(
    "softmax2",
    f"""WITH {R_SQL}, g AS (SELECT event_id, value / 20 AS a, k / 20 AS b FROM r)
    SELECT event_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p1
    FROM g""",
)
def softmax2(spark, sf):
    return readings(spark, sf).select("event_id", r6(S.softmax2(F.col("value") / 20, F.col("k") / 20)).alias("p1"))


@query(
    "rounded_points",
    f"""WITH {S_SQL} SELECT event_id, round(TP2 / 7, 3) AS TP2, round(TP3 / 7, 3) AS TP3,
    round(Motor_current / 7, 3) AS Motor_current, round(Oil_temperature / 7, 2) AS Oil_temperature,
    round(score / 7, 4) AS failure_probability FROM s""",
)
def rounded_points(spark, sf):
    """Values are divided by 7 so that rounding has digits to cut."""
    names = {"TP2": 3, "TP3": 3, "Motor_current": 3, "Oil_temperature": 2, "failure_probability": 4}
    rows = sensors(spark, sf).withColumn("failure_probability", F.col("score"))
    rows = rows.withColumns({n: F.col(n) / 7 for n in names})
    return rows.withColumns(S.chart_point(names)).select("event_id", *names)


@query(
    "text_functions",
    f"""WITH {LOG_SQL} SELECT event_id, lower(equipment) AS lowered, contains(lower(description), '"k": 9') AS hit,
    substring(CAST(ts AS VARCHAR), 1, 10) AS day_text, trim('  ' || type || ' ') AS trimmed,
    concat_ws(';', event_id, equipment, type, severity) AS joined FROM log""",
)
def text_functions(spark, sf):
    return event_log(spark, sf).select(
        "event_id",
        F.lower("equipment").alias("lowered"),
        F.contains(F.lower("description"), F.lit('"k": 9')).alias("hit"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("day_text"),
        F.trim(F.concat(F.lit("  "), "type", F.lit(" "))).alias("trimmed"),
        F.concat_ws(";", F.col("event_id").cast("string"), "equipment", "type", "severity").alias("joined"),
    )


@query(
    "json_roundtrip",
    f"""WITH {R_SQL} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(k AS INTEGER) END AS k,
    CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, event_id % 5 = 0 AS malformed FROM r""",
)
def json_roundtrip(spark, sf):
    """Every fifth document is cut short and must decode to NULL, not fail."""
    doc = F.to_json(F.struct(F.col("k").cast("int").alias("k"), "event_type"))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), doc)).otherwise(doc)
    schema = "k int, event_type string, bad string"
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return (
        readings(spark, sf)
        .select("event_id", parsed.alias("p"))
        .select("event_id", "p.k", "p.event_type", F.col("p.bad").isNotNull().alias("malformed"))
    )


@query(
    "alert_ids",
    f"WITH {R_SQL} SELECT event_id, md5(asset_id || '|' || epoch_us(ts)) AS message_id FROM r",
)
def alert_ids(spark, sf):
    return readings(spark, sf).select("event_id", S.alert_id("asset_id", "ts").alias("message_id"))


@query(
    "time_labels",
    f"""WITH {R_SQL} SELECT event_id, strftime(ts, '%d/%m') AS day_label, strftime(ts, '%H:%M:%S') AS time_label,
    strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, epoch_us(ts) // 1000 AS ms,
    CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) + 7 AS DATE) AS next_week, date_trunc('day', ts)::TIMESTAMP AS midnight
    FROM r""",
)
def time_labels(spark, sf):
    return readings(spark, sf).select(
        "event_id",
        S.day_label("ts").alias("day_label"),
        S.time_label("ts").alias("time_label"),
        S.iso_text("ts").alias("iso"),
        S.epoch_millis("ts").alias("ms"),
        F.to_date("ts").alias("day"),
        F.date_add(F.to_date("ts"), 7).alias("next_week"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("midnight"),
    )
