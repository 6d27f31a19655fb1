"""Streaming queries: everything available in the event table is processed, then read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.scalar import risk_level
from faultlens.operators.features import feature_names
from faultlens.operators.labels import label_intervals
from faultlens.plans.bounded import small
from faultlens.queries.features import full_sql, over
from faultlens.queries.registry import (
    IN_INTERVAL_SQL,
    INTERVALS,
    R_SQL,
    RISK_SQL,
    query,
    r6,
    scratch,
    sensors,
    table,
    to_readings,
)
from faultlens.streaming.live import LivePath
from faultlens.streaming.readings import UpsertByBatch, daily_alerts, daily_alerts_so_far, file_stream, latest_states, run_once, without_repeats
from faultlens.streaming.stateful import with_buffer


BATCHES = 5


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return to_readings(file_stream(spark, sf, schema, "events.parquet"))


def batched(spark, sf, arrival, run, change=lambda rows: rows):
    """The sensor readings in BATCHES micro-batches: `run` takes a stream of what has arrived, and is called after each arrival.

    Micro-batch `i` holds the rows whose `arrival` is i, written by as many tasks as read them.
    """
    path = scratch(spark, "feed")
    rows = change(sensors(spark, sf))
    most = table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    arrives = rows.withColumn("_arrival", arrival(F.least(F.floor(F.col("event_id") * BATCHES / (most + 1)), F.lit(BATCHES - 1))))
    for i in range(BATCHES):
        arrives.where(F.col("_arrival") == i).drop("_arrival").write.mode("append").parquet(path)
        run(file_stream(spark, path, rows.schema))


def on_time(part):
    return part


def appended(spark, out_stream, name):
    path = scratch(spark, name)
    run_once(out_stream, f"{path}/checkpoint", f"{path}/out")
    return spark.read.schema(out_stream.schema).parquet(f"{path}/out")


@query(
    "stream_source_sink",
    f"WITH {R_SQL} SELECT event_id, asset_id, score FROM r WHERE score > 0.3",
)
def stream_source_sink(spark, sf):
    """Source to sink, alert rows only."""
    out = stream(spark, sf).where("score > 0.3").select("event_id", "asset_id", "score")
    return appended(spark, out, "alerts")


def mean_pressure_score(df):
    return df.withColumn("probability", F.least(F.lit(1.0), F.round(F.col("TP2_ma_5") / 500, 6)))


def live(spark, sf, score=mean_pressure_score, arrival=on_time, change=lambda rows: rows):
    """The live path after all micro-batches."""
    path = scratch(spark, "live")
    line = LivePath(f"{path}/live", score)
    batched(spark, sf, arrival, lambda rows: run_once(rows, f"{path}/checkpoint", each=line), change)
    return line


FEATURES = feature_names(True)
FULL_SQL = full_sql().replace("SELECT event_id, round(", f"SELECT row_number() {over()} AS seen, event_id, round(")


@query("stream_features", f"SELECT event_id, {', '.join(FEATURES)} FROM ({FULL_SQL}) WHERE seen >= 16")
def stream_features(spark, sf):
    """Live features of five micro-batches equal the batch ones from the sixteenth reading of an asset on."""
    out = live(spark, sf, None).results(spark).where("is_warm")
    return out.select("event_id", *[r6(c).alias(c) for c in FEATURES])


def one_batch_late(part):
    """Every 97th reading arrives with the batch after its own."""
    return F.when(F.col("event_id") % 97 == 0, F.least(part + 1, F.lit(BATCHES - 1))).otherwise(part)


def broken(rows):
    """Every 53rd reading has a switch that is neither on nor off, every 59th no pressure."""
    rows = rows.withColumn("COMP", F.when(F.col("event_id") % 53 == 0, F.lit(7.0)).otherwise(F.col("COMP")))
    return rows.withColumn("TP2", F.when(F.col("event_id") % 59 == 0, F.lit(None)).otherwise(F.col("TP2")))


ARRIVED_SQL = f"""WITH {R_SQL},
    m AS (SELECT max(event_id) + 1 AS n FROM events),
    p AS (SELECT r.*, least(floor(event_id * {BATCHES} / n), {BATCHES - 1})::INTEGER AS part FROM r, m),
    a AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN least(part + 1, {BATCHES - 1}) ELSE part END AS arrival FROM p)"""


@query(
    "stream_late",
    f"""{ARRIVED_SQL} SELECT event_id, asset_id FROM a
    WHERE EXISTS (SELECT 1 FROM a b WHERE b.asset_id = a.asset_id AND b.arrival < a.arrival AND b.event_id > a.event_id)""",
)
def stream_late(spark, sf):
    """Readings that arrive after a newer one of their asset was taken in are set aside."""
    return live(spark, sf, arrival=one_batch_late).results(spark, "late").select("event_id", "asset_id")


@query(
    "stream_on_time",
    f"""{ARRIVED_SQL} SELECT event_id, asset_id FROM a
    WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.asset_id = a.asset_id AND b.arrival < a.arrival AND b.event_id > a.event_id)""",
)
def stream_on_time(spark, sf):
    """All other readings are in the history once."""
    return live(spark, sf, arrival=one_batch_late).results(spark).select("event_id", "asset_id")


@query(
    "stream_quarantine",
    """SELECT event_id, user_id AS asset_id, array_to_string(list_filter([
      CASE WHEN event_id % 59 = 0 THEN 'missing TP2' END, CASE WHEN event_id % 53 = 0 THEN 'COMP outside 0..1' END], lambda x: x IS NOT NULL), '; ') AS reasons
    FROM events WHERE event_id % 53 = 0 OR event_id % 59 = 0""",
)
def stream_quarantine(spark, sf):
    """Readings with missing or impossible values, and why."""
    out = live(spark, sf, change=broken).results(spark, "quarantine")
    return out.select("event_id", "asset_id", F.array_join("reasons", "; ").alias("reasons"))


@query("stream_keyed_buffer", f"WITH {R_SQL} SELECT event_id, asset_id, round(avg(value) {over('4 PRECEDING')}, 6) AS mean FROM r")
def stream_keyed_buffer(spark, sf):
    """A function that sees each asset's readings in turn, with a buffer in Spark's state store."""

    def step(history, arrived):
        values = list(history["TP2"]) + list(arrived["TP2"])
        first = len(history)
        means = [round(sum(values[max(0, i - 4) : i + 1]) / min(5, i + 1), 6) for i in range(first, len(values))]
        return pd.DataFrame({"event_id": arrived["event_id"].to_numpy(), "mean": means})

    schema = T.StructType.fromDDL("asset_id bigint, event_id bigint, mean double")
    path = scratch(spark, "buffer")

    def run(rows):
        rows = rows.select("asset_id", "event_id", "TP2")
        run_once(with_buffer(rows, "asset_id", "event_id", 4, step, schema), f"{path}/checkpoint", f"{path}/out")

    batched(spark, sf, on_time, run)
    return spark.read.schema(schema).parquet(f"{path}/out").select("event_id", "asset_id", r6("mean").alias("mean"))


@query(
    "stream_scored",
    f"""WITH {R_SQL}, p AS (SELECT *, row_number() {over()} AS n, avg(value) {over('4 PRECEDING')} AS ma FROM r),
    q AS (SELECT event_id, asset_id, least(1.0, round(CASE WHEN n >= 16 THEN ma ELSE value END / 500, 6)) AS probability FROM p)
    SELECT event_id, asset_id, probability FROM q""",
)
def stream_scored(spark, sf):
    """Scores of all readings: cold ones from their snapshot, warm ones from the buffer."""
    return live(spark, sf).results(spark).select("event_id", "asset_id", "probability")


def mean_of_hundred(df):
    return df.withColumn("probability", F.least(F.lit(1.0), F.round(F.col("TP2_ma_5") / 100, 6)))


@query(
    "stream_alerts",
    f"""WITH {R_SQL}, p AS (SELECT *, row_number() {over()} AS n, avg(value) {over('4 PRECEDING')} AS ma FROM r),
    q AS (SELECT asset_id, ts, least(1.0, round(CASE WHEN n >= 16 THEN ma ELSE value END / 100, 6)) AS probability FROM p)
    SELECT 'alert' AS type, md5(asset_id || '|' || epoch_us(ts)) AS message_id,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, CAST(asset_id AS VARCHAR) AS sensor_id, probability,
      CAST(probability >= 0.5 AS INTEGER) AS predicted_class, true AS triggered
    FROM q WHERE probability > 0.7""",
)
def stream_alerts(spark, sf):
    out = live(spark, sf, mean_of_hundred).results(spark, "alerts")
    return out.select("type", "message_id", "timestamp", "sensor_id", "probability", "predicted_class", "triggered")


@query(
    "stream_closed_days",
    f"""WITH {R_SQL}, c AS (SELECT *, {RISK_SQL} AS severity FROM r),
    n AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM c WHERE severity <> 'NORMAL')
    SELECT CAST(ts AS DATE) AS day, count(*) FILTER (severity = 'CRÍTICO') AS critical,
      count(*) FILTER (severity = 'ALERTA') AS alert
    FROM c, n WHERE severity <> 'NORMAL' AND CAST(ts AS DATE) + INTERVAL 1 DAY <= mark GROUP BY 1""",
)
def stream_closed_days(spark, sf):
    """Days are emitted once the watermark has passed their end."""
    rows = stream(spark, sf).withColumn("severity", risk_level("score"))
    return appended(spark, daily_alerts(rows), "daily")


@query(
    "stream_daily_alerts",
    f"""WITH {R_SQL}, c AS (SELECT *, {RISK_SQL} AS severity FROM r)
    SELECT CAST(ts AS DATE) AS day, count(*) FILTER (severity = 'CRÍTICO') AS critical,
      count(*) FILTER (severity = 'ALERTA') AS alert
    FROM c WHERE severity <> 'NORMAL' GROUP BY 1""",
)
def stream_daily_alerts(spark, sf):
    """Counts of all days after five micro-batches, the open day's as they stand."""
    path = scratch(spark, "days")
    days, schemas = UpsertByBatch(f"{path}/out", ["day"]), []

    def run(rows):
        counts = daily_alerts_so_far(rows.withColumn("severity", risk_level("score")))
        schemas.append(counts.schema)
        run_once(counts, f"{path}/checkpoint", each=days, mode="update")

    batched(spark, sf, on_time, run)
    return days.rows(spark, schemas[-1])


@query("stream_dedup", "SELECT DISTINCT user_id AS asset_id, date_trunc('hour', ts)::TIMESTAMP AS slot FROM events")
def stream_dedup(spark, sf):
    """Repeats of (asset, hour) inside the watermark are dropped."""
    rows = stream(spark, sf).withColumn("slot", F.date_trunc("hour", "ts"))
    out = without_repeats(rows, ["asset_id", "slot"])
    return appended(spark, out.select("asset_id", F.col("slot").cast("timestamp_ntz").alias("slot")), "dedup")


@query(
    "stream_enriched",
    f"""WITH {R_SQL} SELECT event_id, CASE WHEN {IN_INTERVAL_SQL} THEN 1 ELSE 0 END AS anomaly,
      coalesce(n_name, 'unknown') AS nation FROM r
    LEFT JOIN customer ON asset_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def stream_enriched(spark, sf):
    """Interval label and asset lookup against static tables."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    assets = table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"), "c_nationkey")
    assets = assets.join(small(nation), "c_nationkey").select("asset_id", "nation")
    rows = label_intervals(stream(spark, sf), INTERVALS, kind="int").join(assets, "asset_id", "left")
    out = rows.select("event_id", "anomaly", F.coalesce("nation", F.lit("unknown")).alias("nation"))
    return appended(spark, out, "enriched")


@query(
    "stream_latest",
    f"""WITH {R_SQL} SELECT asset_id, event_id, score FROM r
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC) = 1""",
)
def stream_latest(spark, sf):
    """Latest state per asset in update mode; each batch replaces its own output."""
    path = scratch(spark, "latest")
    states = latest_states(stream(spark, sf), ["event_id", "score"])

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    run_once(states, f"{path}/checkpoint", each=each, mode="update")
    updates = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
    newest = F.max_by(F.struct("event_id", "score"), "batch")
    return updates.groupBy("asset_id").agg(newest.alias("s")).select("asset_id", "s.*")
