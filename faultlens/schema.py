"""Column contracts and the schema checks made before any job runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sensor column names, in the order models expect them.
ANALOGUE = ["TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Motor_current", "Oil_temperature"]
DIGITAL = ["COMP", "DV_eletric", "Towers", "MPG", "Oil_level"]
UNMODELLED = ["Pressure_switch", "Caudal_impulses", "LPS"]
SENSORS = ANALOGUE + DIGITAL

RAW_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(name, T.DoubleType()) for name in SENSORS + UNMODELLED]
)

READING_SCHEMA = T.StructType(
    [T.StructField("asset_id", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in SENSORS]
)


class MissingColumns(ValueError):
    """The table lacks columns that the caller needs."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN counts as missing; Spark's aggregates skip NULL but not NaN."""
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
        and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def project_contract(df: DataFrame, keep: Sequence[str] = ("asset_id", "ts")) -> DataFrame:
    """The twelve sensors in contract order, after the identifying columns."""
    require_columns(df, [*keep, *SENSORS])
    return df.select(*keep, *SENSORS)


def instant(column: str | Column) -> Column:
    """A zoned timestamp from either timestamp type (watermarks reject NTZ)."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp")


def micros(column: str | Column) -> Column:
    return F.unix_micros(instant(column))
