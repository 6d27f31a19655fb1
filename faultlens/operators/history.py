"""Prediction history pages and the maintenance event log."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.functions.scalar import ALERT, CRITICAL, NORMAL, day_label, one_json_object, severity_rank
from faultlens.plans.bounded import small
from faultlens.plans.positions import SortKey, rows_at, rows_before, sort_keys

MAX_PAGE = 100
# Pages that start deeper than this are found by counts of key ranges, not by a top-n sort.
DEEP_PAGE_ROWS = 100_000


def check_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE}")


def newest_page(
    df: DataFrame,
    page: int = 1,
    size: int = 20,
    order: Sequence[str] = ("ts", "event_id"),
    deep: int = DEEP_PAGE_ROWS,
) -> DataFrame:
    """One page, newest first; past the end it is empty.

    Near pages are a distributed top-n. A top-n of depth page * size would gather
    that many rows in one task, so for deep pages ranges of the key are counted first
    and only the rows of the one or two that hold the page are sorted.
    """
    check_page(page, size)
    skip = (page - 1) * size
    if skip + size <= deep:
        return df.orderBy(*[F.desc(c) for c in order]).offset(skip).limit(size)
    return rows_at(df, sort_keys(order, descending=True), skip, size, deep)


def page_summary(df: DataFrame, page: int, size: int) -> DataFrame:
    check_page(page, size)
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("pages"),
    )


def newest_then_forward(df: DataFrame, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The newest `n` rows, oldest first (the seed of a live chart)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def head_rows(df: DataFrame, n: int, order: Sequence[str] = ("ts", "event_id"), deep: int = DEEP_PAGE_ROWS) -> DataFrame:
    """The first `n` rows in time order; a large head is a filter on the key of its last row."""
    if n <= deep:
        return df.orderBy(*order).limit(n)
    return rows_before(df, sort_keys(order), n, deep)


def last_n(df: DataFrame, n: int, key: str = "asset_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The newest `n` rows per key. Spark limits each group before it is shuffled."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def first_hours(df: DataFrame, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows up to `hours` after the first one, end included."""
    start = df.agg(F.min(ts)).first()[0]
    if start is None:
        return df
    limit = F.lit(start).cast(df.schema[ts].dataType) + F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(F.col(ts) <= limit)


def event_filter(
    as_of: str,
    period_days: int | None = None,
    severity: str | None = None,
    equipment: str | None = None,
    search: str = "",
    ts: str = "ts",
) -> Column:
    """Predicate of the event log; `as_of` is the day the period counts back from."""
    keep = F.lit(True)
    if period_days is not None:
        cutoff = F.date_sub(F.to_date(F.lit(as_of)), period_days)
        keep = keep & (F.col(ts) >= cutoff.cast("timestamp_ntz"))
    if severity is not None:
        keep = keep & (F.col("severity") == severity)
    if equipment is not None:
        keep = keep & (F.col("equipment") == equipment)
    if search:
        q = F.lit(search.lower())
        keep = keep & (F.contains(F.lower("description"), q) | F.contains(F.lower("equipment"), q))
    return keep


def filter_counters(df: DataFrame, keep: Column, active: bool) -> DataFrame:
    return df.agg(
        F.count_if(keep).alias("filtered"),
        F.count("*").alias("total"),
        F.lit(active).alias("filter_active"),
    )


def event_page(
    df: DataFrame,
    column: str = "timestamp",
    descending: bool = True,
    page: int = 1,
    size: int = 10,
    ts: str = "ts",
    tiebreak: str = "event_id",
    deep: int = DEEP_PAGE_ROWS,
) -> DataFrame:
    """A page of the sorted log, clamped to the last page, with its "from-to of n".

    Severity sorts by rank, not by name. The tie-break makes pages disjoint. Only
    pages near either end are taken by a top-n, which would gather all rows before them.
    """
    by = {"timestamp": F.col(ts), "severity": severity_rank("severity")}.get(column)
    by = F.col(column) if by is None else by
    total = df.count()
    last = max(1, ceil(total / size))
    page = min(page, last)
    start = (page - 1) * size
    forward = [by.desc() if descending else by.asc(), F.asc(tiebreak)]
    backward = [by.asc() if descending else by.desc(), F.desc(tiebreak)]
    if start + size <= deep:
        rows = df.orderBy(*forward).offset(start).limit(size)
    elif total - start <= deep:
        # Near the end: the last rows by the reversed order, then the page among them.
        rows = df.orderBy(*backward).limit(total - start).orderBy(*forward).limit(size)
    else:
        rows = rows_at(df, [SortKey(by, descending), SortKey(F.col(tiebreak))], start, size, deep)
    return rows.select(
        "*",
        F.lit(start + 1 if total else 0).cast("bigint").alias("shown_from"),
        F.lit(min(page * size, total)).cast("bigint").alias("shown_to"),
        F.lit(total).cast("bigint").alias("shown_of"),
    )


def daily_alert_counts(df: DataFrame, as_of: str, days: int = 14, ts: str = "ts") -> DataFrame:
    """Critical and alert counts for each of the last `days` days, zeros included."""
    end = F.to_date(F.lit(as_of))
    first = F.date_sub(end, days - 1)
    day = F.to_date(ts)
    counts = (
        df.where(day.between(first, end) & F.col("severity").isin(CRITICAL, ALERT))
        .groupBy(day.alias("day"))
        .agg(
            F.count_if(F.col("severity") == CRITICAL).alias("critical"),
            F.count_if(F.col("severity") == ALERT).alias("alert"),
        )
    )
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(first, end)).alias("day"))
    # At most one row per day of the spine on both sides.
    return spine.join(counts, "day", "left").select(
        "day",
        day_label("day").alias("label"),
        F.coalesce("critical", F.lit(0)).cast("bigint").alias("critical"),
        F.coalesce("alert", F.lit(0)).cast("bigint").alias("alert"),
    )


def alert_peak(daily: DataFrame) -> DataFrame:
    n = F.col("critical") + F.col("alert")
    return daily.agg(
        F.sum(n).alias("total_alerts"),
        F.max(n).alias("peak"),
        F.min_by("day", F.struct((-n).alias("n"), F.col("day").alias("d"))).alias("peak_day"),
    )


def open_alerts(alerts: DataFrame, acknowledged: DataFrame, on: str = "message_id") -> DataFrame:
    return alerts.join(acknowledged.select(on), on, "left_anti")


def valid_entries(df: DataFrame, column: str = "entry") -> DataFrame:
    """Stored JSON entries whose fields have the right JSON types and a known risk."""
    kinds = {"id": "string", "timestamp": "string", "failure_probability": "number", "predicted_class": "number"}
    fields = F.from_json(
        column, ", ".join(f"`{n}` string" for n in [*kinds, "riskLevel"]), {"mode": "PERMISSIVE"}
    )
    # Variant keeps the JSON type, so a quoted number is told from a number.
    raw = F.try_parse_json(one_json_object(column))
    number = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    ok = F.lit(True)
    for name, kind in kinds.items():
        found = F.schema_of_variant(F.try_variant_get(raw, f"$.{name}", "variant"))
        test = found == "STRING" if kind == "string" else F.regexp_like(found, F.lit(f"^({'|'.join(number)})"))
        ok = ok & F.coalesce(test, F.lit(False))
    parsed = df.withColumn("_e", fields).where(ok)
    return parsed.where(F.col("_e.riskLevel").isin(NORMAL, ALERT, CRITICAL)).select(
        *df.columns, *[F.col(f"_e.{n}").alias(n) for n in [*kinds, "riskLevel"]]
    )


def enrich(df: DataFrame, dimension: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup by key with default values; broadcast only if the table is small."""
    return df.join(small(dimension), on, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    )
