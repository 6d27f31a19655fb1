from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators.labels import day_key
from faultlens.queries.registry import (
    IN_INTERVAL_SQL,
    INTERVALS,
    LOG_SQL,
    R_SQL,
    S_SQL,
    event_log,
    query,
    readings,
    scratch,
    sensors,
    table,
)
from faultlens.schema import SENSORS
from faultlens.sources import cards as C
from faultlens.sources import feed as D
from faultlens.sources import ingest as I
from faultlens.sources import sinks as K

CSV_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in SENSORS]
)


def raw_csv(spark, sf):
    """The stand-in readings as a CSV with one column more than the contract."""
    path = scratch(spark, "csv")
    rows = sensors(spark, sf).select(F.col("event_id").alias("extra"), F.col("ts").alias("timestamp"), *SENSORS)
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path


SENSOR_LIST = ", ".join(SENSORS)


@query("csv_roundtrip", f"WITH {S_SQL} SELECT ts AS timestamp, {SENSOR_LIST} FROM s")
def csv_roundtrip(spark, sf):
    return I.read_raw_csv(spark, raw_csv(spark, sf), CSV_SCHEMA)


@query(
    "ingested_readings",
    f"""WITH {S_SQL} SELECT CAST(ts AS DATE) AS day, CASE WHEN {IN_INTERVAL_SQL} THEN 1 ELSE 0 END AS anomaly,
      count(*) AS n, round(sum(CAST(CAST(TP2 AS FLOAT) AS DOUBLE)), 4) AS sum_tp2, min(ts) AS first_ts
    FROM s GROUP BY 1, 2""",
)
def ingested_readings(spark, sf):
    """CSV in, labelled day-partitioned Parquet out, read back."""
    out = scratch(spark, "labelled")
    raw = I.read_raw_csv(spark, raw_csv(spark, sf), CSV_SCHEMA)
    I.write_labelled(I.prepare(raw, INTERVALS), out)
    back = spark.read.parquet(out)
    return back.groupBy("day", F.col("anomaly").cast("int").alias("anomaly")).agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.col("TP2").cast("double")), 4).alias("sum_tp2"),
        F.min("timestamp").alias("first_ts"),
    )


@query(
    "ingest_once",
    f"WITH {S_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS n, 1 AS runs_written FROM s GROUP BY 1",
)
def ingest_once(spark, sf):
    """Two runs of the ingestion; the second finds the labelled output and writes nothing."""
    csv, out = raw_csv(spark, sf), scratch(spark, "once")
    written = sum(I.ingest(spark, csv, out, INTERVALS, CSV_SCHEMA) for _ in range(2))
    return spark.read.parquet(out).groupBy("day").agg(F.count("*").alias("n"), F.lit(written).alias("runs_written"))


@query("parquet_scan_pruned", "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def parquet_scan_pruned(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_totalprice").where("o_totalprice > 200000")


@query(
    "prediction_append",
    f"""WITH {R_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(score), 6) AS sum_score
    FROM r GROUP BY 1""",
)
def prediction_append(spark, sf):
    """Two appends that share days; the stored time decides the partition."""
    path = scratch(spark, "history")
    rows = readings(spark, sf).select("event_id", "ts", "asset_id", "score")
    for part in (0, 1):
        K.append_predictions(rows.where(F.col("event_id") % 2 == part), path)
    back = spark.read.parquet(path)
    return back.groupBy(day_key("ts").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("sum_score")
    )


@query(
    "model_cards",
    f"""WITH {R_SQL} SELECT event_type AS model_name, CASE WHEN event_type = 'click' THEN 0.5 ELSE round(avg(score), 6) END
      AS threshold, count(*) AS n_train, round(max(score), 6) AS best FROM r GROUP BY event_type""",
)
def model_cards(spark, sf):
    """Cards written and read back; a broken file is skipped, a bad threshold defaults."""
    path = scratch(spark, "cards")
    cards = readings(spark, sf).groupBy(F.col("event_type").alias("model_name")).agg(
        F.when(F.first("event_type") == "click", "n/a")
        .otherwise(F.round(F.avg("score"), 6).cast("string"))
        .alias("decision_threshold"),
        F.count("*").alias("n_train"),
        F.create_map(F.lit("best"), F.round(F.max("score"), 6)).alias("metrics"),
    )
    C.write_cards(cards, path)
    spark.range(1).select(F.lit("{not json").alias("value")).write.mode("append").text(path)
    back = C.read_cards(spark, path, multi_line=False)
    return back.select("model_name", "threshold", "n_train", F.col("metrics")["best"].alias("best"))


@query(
    "event_json",
    f"""WITH {S_SQL} SELECT 'sensor_reading' AS event, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS id,
      strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, TP2, Oil_level FROM s""",
)
def event_json(spark, sf):
    """Readings as JSON events, decoded again to compare their content."""
    out = D.to_events(sensors(spark, sf))
    body = F.from_json("data", "timestamp string, TP2 double, Oil_level double")
    return out.select("event", "id", body.alias("b")).select(
        "event", "id", F.col("b.timestamp").alias("stamp"), "b.TP2", "b.Oil_level"
    )


@query(
    "event_csv_rows",
    f"""WITH {LOG_SQL} SELECT event_id || ';' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ';' || equipment || ';' || type
      || ';' || severity || ';' || duration AS line FROM log""",
)
def event_csv_rows(spark, sf):
    """The export written as CSV and read back as text, header lines left out."""
    path = scratch(spark, "export")
    log = event_log(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    K.export_event_log(log, path)
    text = spark.read.text(path)
    return text.where(~F.col("value").contains("Equipamento")).select(F.col("value").alias("line"))


def lines(spark, sf):
    """Feed lines per asset: valid, cut short, one field missing, not an event, or with more behind the object."""
    e = F.col("event_id") % 10
    s = sensors(spark, sf)
    whole = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), *SENSORS))
    partial = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), *SENSORS[1:]))
    text = (
        F.when(e == 0, F.concat(F.lit("data: "), F.substring(whole, 1, 20)))
        .when(e == 1, F.concat(F.lit("data: "), partial))
        .when(e == 2, F.lit("event: sensor_reading"))
        .when(e == 3, F.concat(F.lit("data: "), whole, F.lit(" junk")))
        .when(e == 4, F.concat(F.lit("data: "), whole, F.lit(","), whole))
        .otherwise(D.to_lines(s, whole))
    )
    return s.select(F.col("asset_id").alias("client_id"), text.alias("line"))


QUALITY_SQL = """q AS (SELECT user_id AS client_id, count(*) FILTER (event_id % 10 > 4) AS events,
  count(*) FILTER (event_id % 10 IN (0, 3, 4)) AS malformed, count(*) FILTER (event_id % 10 = 1) AS incomplete
  FROM events WHERE event_id % 10 <> 2 GROUP BY user_id)"""


@query("feed_quality", f"WITH {QUALITY_SQL} SELECT * FROM q")
def feed_quality(spark, sf):
    return D.feed_quality(lines(spark, sf))


@query(
    "feed_totals",
    f"""WITH {QUALITY_SQL} SELECT count(*) AS clients, count(*) AS ok_clients, 0::BIGINT AS failed_clients,
      CAST(sum(events) AS BIGINT) AS total_events, CAST(sum(malformed + incomplete) AS BIGINT) AS bad_events,
      round(sum(events) / count(*), 1) AS avg_events, count(*) >= 50 AS enough_clients,
      sum(events) / count(*) >= 60 * 0.8 AS enough_events FROM q""",
)
def feed_totals(spark, sf):
    return D.feed_totals(D.feed_quality(lines(spark, sf)), 60)
