from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import labels as L
from faultlens.operators.windows import healthy_windows, sliding_windows
from faultlens.queries.registry import (
    IN_INTERVAL_SQL,
    INTERVALS,
    L_SQL,
    R_SQL,
    labelled,
    query,
    readings,
    sensors,
    table,
)

LABEL = f"CASE WHEN {IN_INTERVAL_SQL} THEN 1 ELSE 0 END"


@query("interval_label", f"WITH {R_SQL} SELECT event_id, {LABEL} AS anomaly FROM r")
def interval_label(spark, sf):
    return L.label_intervals(readings(spark, sf), INTERVALS, kind="int").select("event_id", "anomaly")


ORDERS_AS_INTERVALS = """iv AS (
  SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43000 AS INTEGER)) AS a,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43000 + o_custkey % 30 AS INTEGER)) AS b
  FROM orders)"""


@query(
    "interval_label_range_join",
    f"""WITH {ORDERS_AS_INTERVALS}
    SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE ts BETWEEN a AND b) THEN 1 ELSE 0 END AS anomaly
    FROM events""",
)
def interval_label_range_join(spark, sf):
    """The interval table is as large as `orders`, with many overlaps."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    minute = F.col("o_orderkey") % 43000
    intervals = table(spark, sf, "orders").select(
        (start + F.make_dt_interval(mins=minute.cast("int"))).alias("start"),
        (start + F.make_dt_interval(mins=(minute + F.col("o_custkey") % 30).cast("int"))).alias("end"),
    )
    events = table(spark, sf, "events").select("event_id", "ts")
    return L.label_by_table(events, intervals, kind="int").select("event_id", "anomaly")


@query(
    "healthy_faulty_split",
    f"""WITH {L_SQL} SELECT CASE anomaly WHEN 1 THEN 'faulty' ELSE 'healthy' END AS side,
    count(*) AS n, round(avg(TP2), 6) AS mean_tp2, round(avg(TP3), 6) AS mean_tp3 FROM l GROUP BY 1""",
)
def healthy_faulty_split(spark, sf):
    healthy, faulty = L.healthy_faulty_split(sensors(spark, sf), INTERVALS)
    both = healthy.withColumn("side", F.lit("healthy")).unionByName(faulty.withColumn("side", F.lit("faulty")))
    return both.groupBy("side").agg(
        F.count("*").alias("n"),
        F.round(F.avg("TP2"), 6).alias("mean_tp2"),
        F.round(F.avg("TP3"), 6).alias("mean_tp3"),
    )


@query(
    "failure_rate",
    f"""WITH {L_SQL} SELECT count(*) AS n_rows, CAST(sum(anomaly) AS BIGINT) AS n_faults,
    round(avg(anomaly) * 100, 4) AS failure_pct FROM l""",
)
def failure_rate(spark, sf):
    return L.failure_rate(labelled(spark, sf))


@query(
    "healthy_windows",
    f"""WITH {L_SQL},
    i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM l),
    w AS (SELECT unnest(range(0, (SELECT max(n) FROM i) - 59, 10)) AS lo)
    SELECT CAST(lo // 10 AS BIGINT) AS wid, round(avg(TP2), 6) AS mean_tp2
    FROM w JOIN i ON rn BETWEEN lo AND lo + 59 GROUP BY lo HAVING max(anomaly) = 0""",
)
def healthy_windows_query(spark, sf):
    w = sliding_windows(labelled(spark, sf), ["TP2"], label="anomaly")
    total = F.aggregate("x", F.lit(0.0), lambda s, row: s + row[0])
    return healthy_windows(w).select("wid", F.round(total / 60, 6).alias("mean_tp2"))


FLAGSHIP_SQL = f"""WITH {R_SQL},
f AS (
  SELECT {LABEL} AS anomaly, {{risk}} AS risk,
    coalesce(stddev_samp(value) OVER (PARTITION BY asset_id ORDER BY ts, event_id ROWS 4 PRECEDING), 0) AS std_5,
    avg(value) OVER (PARTITION BY asset_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS ma_5,
    avg(value) OVER (PARTITION BY asset_id ORDER BY ts, event_id ROWS 14 PRECEDING) AS ma_15,
    coalesce(value - lag(value) OVER (PARTITION BY asset_id ORDER BY ts, event_id), 0) AS delta
  FROM r)
SELECT anomaly, risk, count(*) AS n, round(avg(std_5), 6) AS avg_std_5, round(avg(ma_5), 6) AS avg_ma_5,
  round(avg(ma_15), 6) AS avg_ma_15, round(avg(delta), 6) + 0.0 AS avg_delta
FROM f GROUP BY anomaly, risk"""


@query(
    "labelled_risk_summary",
    FLAGSHIP_SQL.format(
        risk="CASE WHEN score < 0.30 THEN 'NORMAL' WHEN score < 0.65 THEN 'ALERTA' ELSE 'CRÍTICO' END"
    ),
)
def labelled_risk_summary(spark, sf):
    """Interval label, rolling features per asset, risk band, counts per (label, band)."""
    from faultlens.functions.scalar import risk_level
    from faultlens.operators.features import delta, rolling_mean, rolling_std
    from faultlens.plans.series import lay_out

    rows = L.label_intervals(readings(spark, sf), INTERVALS, kind="int").select(
        "event_id", "ts", "asset_id", "value", "anomaly", risk_level("score").alias("risk")
    )

    def build(df, w, long):
        return df.withColumns(
            {
                "std_5": rolling_std("value", w, 5),
                "ma_5": rolling_mean("value", w, 5),
                "ma_15": rolling_mean("value", w, 15),
                "delta": delta("value", w),
            }
        )

    return (
        lay_out(rows, "asset_id")
        .roll(14, build)
        .rows.groupBy("anomaly", "risk")
        .agg(
            F.count("*").alias("n"),
            *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("std_5", "ma_5", "ma_15", "delta")],
        )
    )
