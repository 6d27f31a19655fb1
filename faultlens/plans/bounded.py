"""Broadcasts that are checked, not assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: texts and binaries by length, nested values by their JSON."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("x")))), F.lit(0)) + 16)
        else:
            parts.append(F.lit(16))
    return sum(parts[1:], parts[0]).cast("bigint")


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most `limit` rows and `most_bytes`; reads at most `limit + 1` rows."""
    size = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return size["n"] <= limit and size["b"] <= most_bytes


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when `df` is measured to be small in rows and bytes.

    Beyond that the frame is returned unhinted, so the join shuffles and AQE may
    split its skewed partitions. Call it on cut or otherwise cheap frames.
    """
    return F.broadcast(df) if is_small(df, limit, most_bytes) else df
