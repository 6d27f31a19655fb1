"""Reading streams and the event-time operators on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultlens.functions.scalar import ALERT, CRITICAL
from faultlens.schema import instant

LATENESS = "10 minutes"


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Readings from arriving files, with a zoned event time that watermarks accept."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(ts, instant(ts))


def topic_stream(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, rows_per_batch: int | None = None
) -> DataFrame:
    """Readings from a Kafka topic of JSON values (needs the connector on the class path)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    )
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Drop repeats of the keys while the watermark still remembers them."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def daily_alerts(stream: DataFrame, severity: str = "severity", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Critical and alert counts per day, emitted once when the day is closed."""
    return (
        stream.where(F.col(severity).isin(CRITICAL, ALERT))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day"))
        .agg(
            F.count_if(F.col(severity) == CRITICAL).alias("critical"),
            F.count_if(F.col(severity) == ALERT).alias("alert"),
        )
        .select(F.to_date("window.start").alias("day"), "critical", "alert")
    )


def daily_alerts_so_far(stream: DataFrame, severity: str = "severity", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Critical and alert counts per day, for update mode: a batch emits the days it has changed, open ones too.

    The watermark bounds the days whose counts are kept in the state; `UpsertByBatch` keeps what was emitted.
    """
    return daily_alerts(stream, severity, ts, lateness)


class UpsertByBatch:
    """Keeps update-mode rows by (key, batch); the newest batch holds the value of a key."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The newest row of each key."""
        whole = T.StructType(list(schema.fields)).add("batch", "long")
        every = spark.read.schema(whole).option("basePath", self.path).parquet(f"{self.path}/batch=*")
        values = [f.name for f in schema.fields if f.name not in self.keys]
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        return newest.select(*self.keys, "_v.*")


def latest_states(stream: DataFrame, columns: list[str], key: str = "asset_id", ts: str = "ts") -> DataFrame:
    """Newest state per asset, for update mode; state is one struct per asset."""
    newest = F.max_by(F.struct(ts, *columns), F.col(ts))
    return stream.groupBy(key).agg(newest.alias("_s")).select(key, "_s.*")


def run_once(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Process everything available, into Parquet at `path` or through `each`, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()
    return query
