"""Prediction history, alert and event-log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.labels import day_key

# Header of the event-log export; the first name carries the UTF-8 BOM.
EXPORT = {
    "event_id": "\ufeffID",
    "ts": "Timestamp",
    "equipment": "Equipamento",
    "type": "Tipo",
    "severity": "Severidade",
    "duration": "Duração",
}


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows gathered by day: few files per day, several for a crowded day, which is split by its size. No pass over the rows samples them first."""
    return df.withColumn("day", day_key(ts)).hint("rebalance", F.col("day"))


def append_predictions(scored: DataFrame, path: str, ts: str = "ts") -> None:
    """Append scored readings, partitioned by day; the stored time is the row's own."""
    _by_day(scored, ts).write.mode("append").partitionBy("day").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, ts: str | None = None) -> None:
    """Write one micro-batch under its id, so that a replay replaces it.

    With `ts` the batch is partitioned by day. Without, even an empty batch leaves a
    file that carries the schema.
    """
    target = f"{path}/batch={batch_id}"
    if ts:
        _by_day(df, ts).write.mode("overwrite").partitionBy("day").parquet(target)
    else:
        df.write.mode("overwrite").parquet(target)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches below `path`."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def export_rows(events: DataFrame) -> DataFrame:
    """The six exported columns under their header names (the description is left out)."""
    return events.select(*[F.col(c).cast("string").alias(name) for c, name in EXPORT.items()])


def export_event_log(events: DataFrame, path: str) -> None:
    """Semicolon-separated CSV with header; takes any (also a filtered) event frame."""
    export_rows(events).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
