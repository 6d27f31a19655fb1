"""The text feed of live readings: events out, quality checks in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.scalar import epoch_millis, iso_text, one_json_object
from faultlens.schema import SENSORS

# The fields every event must carry, and the line prefix of an event.
REQUIRED = ["timestamp", *SENSORS]
PREFIX = "data: "
EVENT = "sensor_reading"
MIN_CLIENTS = 50
MIN_SHARE = 0.8


def to_events(df: DataFrame, ts: str = "ts", columns: Sequence[str] = SENSORS) -> DataFrame:
    """Readings as (event, id, data): id is the epoch millisecond, data is JSON."""
    body = F.struct(iso_text(ts).alias("timestamp"), *columns)
    return df.select(
        F.lit(EVENT).alias("event"),
        epoch_millis(ts).cast("string").alias("id"),
        F.to_json(body).alias("data"),
    )


def to_lines(df: DataFrame, data: str | Column = "data") -> Column:
    return F.concat(F.lit(PREFIX), data)


def classify(lines: DataFrame, required: Sequence[str] = REQUIRED, line: str = "line") -> DataFrame:
    """Add `status`: valid, malformed or incomplete; lines that carry no event are dropped."""
    body = F.substring(line, len(PREFIX) + 1, 2**31 - 1)
    # Each document is parsed once; the status only looks at the key list.
    events = lines.where(F.col(line).startswith(PREFIX)).withColumn("_keys", F.json_object_keys(one_json_object(body)))
    absent = F.array_except(F.array(*[F.lit(c) for c in required]), F.col("_keys"))
    status = (
        F.when(F.col("_keys").isNull(), "malformed").when(F.size(absent) > 0, "incomplete").otherwise("valid")
    )
    return events.withColumn("status", status).drop("_keys")


def feed_quality(lines: DataFrame, required: Sequence[str] = REQUIRED, client: str = "client_id") -> DataFrame:
    """Valid events, malformed events and incomplete events per client."""
    return (
        classify(lines, required)
        .groupBy(client)
        .agg(
            F.count_if(F.col("status") == "valid").alias("events"),
            F.count_if(F.col("status") == "malformed").alias("malformed"),
            F.count_if(F.col("status") == "incomplete").alias("incomplete"),
        )
    )


def feed_totals(
    quality: DataFrame,
    duration: float,
    error: str | None = None,
    min_clients: int = MIN_CLIENTS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Totals over clients without error, and whether both load gates pass."""
    ok = F.col(error).isNull() if error else F.lit(True)
    events = F.coalesce(F.sum(F.when(ok, F.col("events"))), F.lit(0))
    n_ok = F.count_if(ok)
    average = events / F.greatest(n_ok, F.lit(1))
    return quality.agg(
        F.count("*").alias("clients"),
        n_ok.alias("ok_clients"),
        F.count_if(~ok).alias("failed_clients"),
        events.alias("total_events"),
        F.coalesce(F.sum(F.when(ok, F.col("malformed") + F.col("incomplete"))), F.lit(0)).alias("bad_events"),
        F.round(average, 1).alias("avg_events"),
        (n_ok >= min_clients).alias("enough_clients"),
        (average >= duration * min_share).alias("enough_events"),
    )
