"""Fault labels from closed failure intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.plans.bounded import BROADCAST_ROWS
from faultlens.plans.series import lay_out
from faultlens.schema import instant, micros
from faultlens.session import cut

# The four documented failure intervals, both ends included.
FAILURES = (
    ("2020-04-18 00:00:00", "2020-04-18 23:59:00"),
    ("2020-05-29 23:30:00", "2020-05-30 06:00:00"),
    ("2020-06-05 10:00:00", "2020-06-07 14:30:00"),
    ("2020-07-15 14:30:00", "2020-07-15 19:00:00"),
)
# More literals than this make the predicate slower than a join.
MAX_LITERALS = 50
HOUR = 3_600_000_000


def in_any_interval(ts: str, intervals: Sequence[tuple[str, str]] = FAILURES) -> Column:
    if not intervals:
        return F.lit(False)
    at = F.col(ts).cast("timestamp_ntz")
    tests = [
        at.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
        for a, b in intervals
    ]
    return F.coalesce(reduce(lambda x, y: x | y, tests), F.lit(False))


def label_intervals(
    df: DataFrame,
    intervals: Sequence[tuple[str, str]] = FAILURES,
    ts: str = "ts",
    label: str = "anomaly",
    kind: str = "tinyint",
) -> DataFrame:
    """1 inside any closed interval, else 0. A few intervals stay inside codegen."""
    if len(intervals) > MAX_LITERALS:
        table = df.sparkSession.createDataFrame(list(intervals), "start string, end string")
        table = table.select(
            F.col("start").cast("timestamp_ntz").alias("start"),
            F.col("end").cast("timestamp_ntz").alias("end"),
        )
        return label_by_table(df, table, ts, label, kind)
    return df.withColumn(label, in_any_interval(ts, intervals).cast("int").cast(kind))


def islands(intervals: DataFrame, start: str = "start", end: str = "end", target_rows: int | None = None) -> DataFrame:
    """Overlapping closed intervals merged to disjoint ones, as microseconds `_a`, `_b`.

    Copies collapse first. The running maximum of the ends before a start tells
    whether a new island begins; it is taken over cells of the start order.
    """
    spans = intervals.where(F.col(start) <= F.col(end)).groupBy(micros(start).alias("_a")).agg(
        F.max(micros(end)).alias("_b")
    )
    opened = (
        lay_out(spans, (), ("_a",), target_rows)
        .running("_b", "max", "_reach", exclusive=True)
        .roll(0, lambda df, w, long: df.withColumn("_new", F.coalesce(F.col("_a") > F.col("_reach"), F.lit(True)).cast("int")))
        .running("_new", "sum", "_island")
        .rows
    )
    return opened.groupBy("_island").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_island")


def label_by_table(
    df: DataFrame,
    intervals: DataFrame,
    ts: str = "ts",
    label: str = "anomaly",
    kind: str = "tinyint",
    start: str = "start",
    end: str = "end",
    target_rows: int | None = None,
    per_hour: int = 64,
) -> DataFrame:
    """Label from an interval table of any size; overlaps cannot repeat a reading.

    Merged intervals are disjoint. While their hourly pieces are few enough to be
    broadcast and no hour has many, readings meet them by an equi-join on the hour,
    which moves no reading. Otherwise each reading looks up the last island that
    starts at or before it, which is linear work however crowded an hour is.
    """
    merged = cut(islands(intervals, start, end, target_rows))
    pieces = merged.select(
        "_a", "_b", F.explode(F.sequence(F.floor(F.col("_a") / HOUR), F.floor(F.col("_b") / HOUR))).alias("_h")
    )
    crowd = pieces.groupBy("_h").count().agg(F.max("count").alias("top"), F.sum("count").alias("n")).first()
    rows = df.withColumn("_at", micros(ts))
    if crowd["n"] is None:
        return df.withColumn(label, F.lit(0).cast(kind))
    if crowd["n"] <= BROADCAST_ROWS and crowd["top"] <= per_hour:
        inside = (F.floor(F.col("_at") / HOUR) == F.col("_h")) & F.col("_at").between(F.col("_a"), F.col("_b"))
        hit = rows.join(F.broadcast(pieces), inside, "left")
        return hit.withColumn(label, F.col("_h").isNotNull().cast("int").cast(kind)).drop("_at", "_h", "_a", "_b")
    starts = merged.select(F.col("_a").alias("_at"), F.col("_b"))
    stacked = rows.withColumn("_side", F.lit(1)).unionByName(
        starts.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    # Readings of one instant need no order among themselves; the hash only splits crowds, and maps have none.
    hashed = [f"`{f.name}`" for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    laid = lay_out(stacked.withColumn("_mix", F.xxhash64("_at", *hashed)), (), ("_at", "_side", "_mix"), target_rows)
    found = laid.fill(["_b"]).rows.where(F.col("_side") == 1)
    covered = F.coalesce(F.col("_at") <= F.col("_b"), F.lit(False))
    return found.withColumn(label, covered.cast("int").cast(kind)).select(*df.columns, label)


def healthy_faulty_split(
    df: DataFrame,
    intervals: Sequence[tuple[str, str]] = FAILURES,
    ts: str = "ts",
    label: str = "anomaly",
) -> tuple[DataFrame, DataFrame]:
    """Healthy and faulty rows, by timestamp, else by label column, else all healthy.

    An empty faulty side falls back to the healthy rows.
    """
    if ts in df.columns:
        faulty = in_any_interval(ts, intervals)
    elif label in df.columns:
        faulty = F.coalesce(F.col(label) == 1, F.lit(False))
    else:
        faulty = F.lit(False)
    healthy, failed = df.where(~faulty), df.where(faulty)
    return healthy, healthy if failed.isEmpty() else failed


def failure_rate(df: DataFrame, label: str = "anomaly") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col(label).cast("bigint")).alias("n_faults"),
        F.round(F.avg(label) * 100, 4).alias("failure_pct"),
    )


def day_key(ts: str = "ts") -> Column:
    return F.to_date(instant(ts))
