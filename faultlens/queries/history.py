from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions.scalar import NORMAL, decide
from faultlens.operators import history as H
from faultlens.operators.asof import asof_join
from faultlens.queries.registry import AS_OF, LOG_SQL, R_SQL, RISK_SQL, event_log, query, readings, table

HISTORY = "SELECT event_id, asset_id, value, score, CAST(score >= 0.5 AS INTEGER) AS predicted_class FROM r"
NEWEST = "ORDER BY ts DESC, event_id DESC"


def history(spark, sf):
    return readings(spark, sf).select(
        "event_id", "ts", "asset_id", "value", "score", decide("score").alias("predicted_class")
    )


@query("prediction_page", f"WITH {R_SQL} {HISTORY} {NEWEST} LIMIT 20 OFFSET 40")
def prediction_page(spark, sf):
    return H.newest_page(history(spark, sf), page=3, size=20).drop("ts")


@query("prediction_deep_page", f"WITH {R_SQL} {HISTORY} {NEWEST} LIMIT 100 OFFSET 4900")
def prediction_deep_page(spark, sf):
    """A page found by counts of key ranges instead of a top-n sort."""
    return H.newest_page(history(spark, sf), page=50, size=100, deep=0).drop("ts")


@query(
    "page_summary",
    """SELECT count(*) AS total, 3 AS page, 20 AS size, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM events""",
)
def page_summary(spark, sf):
    return H.page_summary(table(spark, sf, "events"), 3, 20)


@query("latest_prediction", f"WITH {R_SQL} {HISTORY} {NEWEST} LIMIT 1")
def latest_prediction(spark, sf):
    return H.newest_page(history(spark, sf), 1, 1).drop("ts")


@query("seed_newest_30", f"WITH {R_SQL}, n AS (SELECT * FROM r {NEWEST} LIMIT 30) SELECT event_id, score FROM n")
def seed_newest_30(spark, sf):
    return H.newest_then_forward(history(spark, sf), 30).select("event_id", "score")


@query("head_n", f"WITH {R_SQL} SELECT event_id, value FROM r ORDER BY ts, event_id LIMIT 5000")
def head_n(spark, sf):
    return H.head_rows(history(spark, sf), 5000).select("event_id", "value")


@query(
    "last_n_per_asset",
    f"""WITH {R_SQL} SELECT asset_id, event_id, CAST(row_number() OVER (PARTITION BY asset_id {NEWEST}) AS INTEGER)
    AS recency FROM r QUALIFY recency <= 30""",
)
def last_n_per_asset(spark, sf):
    return H.last_n(readings(spark, sf).select("event_id", "ts", "asset_id"), 30).drop("ts")


@query(
    "first_24h",
    f"WITH {R_SQL} SELECT event_id FROM r WHERE ts <= (SELECT min(ts) FROM r) + INTERVAL 24 HOUR",
)
def first_24h(spark, sf):
    return H.first_hours(readings(spark, sf)).select("event_id")


ASOF_SQL = f"""WITH {R_SQL},
p AS (SELECT event_id, asset_id, ts, score FROM r WHERE event_type IN ('view', 'error')),
q AS (SELECT event_id, asset_id, ts FROM r WHERE event_type NOT IN ('view', 'error'))"""


@query(
    "asof_latest_prediction",
    f"""{ASOF_SQL} SELECT q.event_id, p.event_id AS prediction_id, p.score AS probability
    FROM q ASOF LEFT JOIN p ON q.asset_id = p.asset_id AND q.ts >= p.ts""",
)
def asof_latest_prediction(spark, sf):
    rows = readings(spark, sf)
    predicting = F.col("event_type").isin("view", "error")
    p = rows.where(predicting).select(
        "event_id", "asset_id", "ts", F.col("event_id").alias("prediction_id"), F.col("score").alias("probability")
    )
    q = rows.where(~predicting).select("event_id", "asset_id", "ts")
    return asof_join(q, p, "asset_id", ["prediction_id", "probability"]).drop("asset_id", "ts")


@query(
    "asof_last_reading",
    f"""WITH {R_SQL}, a AS (SELECT * FROM r WHERE event_type = 'error'), b AS (SELECT * FROM r WHERE event_type <> 'error')
    SELECT a.event_id, coalesce(b.value, 0) AS TP2, coalesce(b.k, 0) AS TP3
    FROM a ASOF LEFT JOIN b ON a.asset_id = b.asset_id AND a.ts >= b.ts""",
)
def asof_last_reading(spark, sf):
    """Each alert with the last reading before it, zeros if there is none."""
    rows = readings(spark, sf)
    alerts = rows.where("event_type = 'error'").select("event_id", "asset_id", "ts")
    seen = rows.where("event_type <> 'error'").select(
        "event_id", "asset_id", "ts", F.col("value").alias("TP2"), F.col("k").alias("TP3")
    )
    out = asof_join(alerts, seen, "asset_id", ["TP2", "TP3"])
    return out.select("event_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("TP2", "TP3")])


FILTER_SQL = """ts >= TIMESTAMP '2024-01-16' AND severity = 'NORMAL'
  AND (contains(lower(description), 'k": 4') OR contains(lower(equipment), 'k": 4'))"""


def a_filter():
    return H.event_filter(AS_OF, 14, NORMAL, None, 'K": 4')


@query("event_filter", f"WITH {LOG_SQL} SELECT event_id, equipment, severity FROM log WHERE {FILTER_SQL}")
def event_filter(spark, sf):
    return event_log(spark, sf).where(a_filter()).select("event_id", "equipment", "severity")


@query(
    "filter_counters",
    f"""WITH {LOG_SQL} SELECT count(*) FILTER ({FILTER_SQL}) AS filtered, count(*) AS total, true AS filter_active
    FROM log""",
)
def filter_counters(spark, sf):
    return H.filter_counters(event_log(spark, sf), a_filter(), True)


RANK_SQL = "CASE severity WHEN 'CRÍTICO' THEN 2 WHEN 'ALERTA' THEN 1 ELSE 0 END"


@query(
    "event_sort_severity",
    f"""WITH {LOG_SQL}, n AS (SELECT count(*) AS n FROM log)
    SELECT event_id, equipment, severity, CAST(21 AS BIGINT) AS shown_from, CAST(30 AS BIGINT) AS shown_to, n AS shown_of
    FROM log, n ORDER BY {RANK_SQL} DESC, event_id LIMIT 10 OFFSET 20""",
)
def event_sort_severity(spark, sf):
    out = H.event_page(event_log(spark, sf), "severity", True, page=3)
    return out.select("event_id", "equipment", "severity", "shown_from", "shown_to", "shown_of")


@query(
    "event_last_page",
    f"""WITH {LOG_SQL}, n AS (SELECT count(*) AS n, (count(*) - 1) // 10 * 10 AS start FROM log)
    SELECT event_id, CAST(start + 1 AS BIGINT) AS shown_from, n AS shown_to, n AS shown_of
    FROM (SELECT *, row_number() OVER (ORDER BY equipment, event_id) AS rn FROM log), n WHERE rn > start""",
)
def event_last_page(spark, sf):
    """A page number past the end is clamped to the last page."""
    out = H.event_page(event_log(spark, sf), "equipment", False, page=10**6)
    return out.select("event_id", "shown_from", "shown_to", "shown_of")


@query(
    "event_middle_page",
    f"""WITH {LOG_SQL}, o AS (SELECT *, CASE severity WHEN 'NORMAL' THEN 0 WHEN 'ALERTA' THEN 1 ELSE 2 END AS rank FROM log),
    n AS (SELECT count(*) AS n, (count(*) // 20) * 10 AS start FROM log)
    SELECT event_id, CAST(start + 1 AS BIGINT) AS shown_from, CAST(start + 10 AS BIGINT) AS shown_to, n AS shown_of
    FROM (SELECT *, row_number() OVER (ORDER BY rank DESC, event_id) AS rn FROM o), n WHERE rn > start AND rn <= start + 10""",
)
def event_middle_page(spark, sf):
    """The page in the middle of the log by severity, where no top-n from either end is short."""
    log = event_log(spark, sf)
    out = H.event_page(log, "severity", True, page=log.count() // 20 + 1, deep=100)
    return out.select("event_id", "shown_from", "shown_to", "shown_of")


@query("head_by_range", f"WITH {R_SQL} SELECT event_id, value FROM r ORDER BY ts, event_id LIMIT (SELECT count(*) // 2 FROM events)")
def head_by_range(spark, sf):
    """A head too large for a top-n: a filter on the key of its last row."""
    rows = history(spark, sf)
    return H.head_rows(rows, rows.count() // 2, deep=100).select("event_id", "value")


DAILY_SQL = LOG_SQL + """,
spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT s.day, strftime(s.day, '%d/%m') AS label,
    count(event_id) FILTER (severity = 'CRÍTICO') AS critical, count(event_id) FILTER (severity = 'ALERTA') AS alert
  FROM spine s LEFT JOIN log ON CAST(ts AS DATE) = s.day GROUP BY s.day)"""


@query("daily_alert_counts", f"WITH {DAILY_SQL} SELECT * FROM daily")
def daily_alert_counts(spark, sf):
    return H.daily_alert_counts(event_log(spark, sf), AS_OF)


@query(
    "alert_peak",
    f"""WITH {DAILY_SQL} SELECT CAST(sum(critical + alert) AS BIGINT) AS total_alerts, max(critical + alert) AS peak,
    (SELECT day FROM daily ORDER BY critical + alert DESC, day LIMIT 1) AS peak_day FROM daily""",
)
def alert_peak(spark, sf):
    return H.alert_peak(H.daily_alert_counts(event_log(spark, sf), AS_OF))


@query(
    "open_alerts",
    f"""WITH {R_SQL} SELECT event_id, score FROM r WHERE score > 0.3 AND NOT EXISTS (
      SELECT 1 FROM events e WHERE e.event_type = 'view' AND e.event_id = r.event_id)""",
)
def open_alerts(spark, sf):
    rows = readings(spark, sf)
    alerts = rows.where("score > 0.3").select("event_id", "score")
    return H.open_alerts(alerts, rows.where("event_type = 'view'"), "event_id")


@query(
    "valid_entries",
    f"""WITH {R_SQL} SELECT event_id, 'p' || event_id AS id, {RISK_SQL} AS "riskLevel"
    FROM r WHERE event_id % 8 > 6""",
)
def valid_entries(spark, sf):
    """Seven of eight stored entries break one rule each: type, enum, field, syntax, quoting, text or an object behind."""
    from faultlens.functions.scalar import risk_level

    e = F.col("event_id") % 8
    name = F.concat(F.lit("p"), F.col("event_id").cast("string"))
    p = F.col("score")

    def entry(probability, risk):
        return F.to_json(
            F.struct(
                name.alias("id"),
                F.col("ts").cast("string").alias("timestamp"),
                probability.alias("failure_probability"),
                decide("score").alias("predicted_class"),
                risk.alias("riskLevel"),
            )
        )

    good = entry(p, risk_level("score"))
    text = (
        F.when(e == 0, entry(p.cast("string"), risk_level("score")))
        .when(e == 1, entry(p, F.lit("UNKNOWN")))
        .when(e == 2, entry(F.when(F.lit(False), p), risk_level("score")))
        .when(e == 3, F.concat(F.lit("{"), good))
        .when(e == 4, F.lit("[]"))
        .when(e == 5, F.concat(good, F.lit(" junk")))
        .when(e == 6, F.concat(good, F.lit(","), good))
        .otherwise(good)
    )
    stored = readings(spark, sf).select("event_id", text.alias("entry"))
    return H.valid_entries(stored).select("event_id", "id", "riskLevel")


@query(
    "asset_lookup",
    """SELECT c_custkey, coalesce(CASE WHEN n_regionkey <> 2 THEN n_name END, 'unknown') AS nation
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def asset_lookup(spark, sf):
    """Region 2 is left out of the dimension, so its rows take the default."""
    dim = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")
    )
    out = H.enrich(table(spark, sf, "customer"), dim, "c_nationkey", {"nation": "unknown"})
    return out.select("c_custkey", "nation")


