"""Slices from the middle of a big table, found by counting ranges of the sort key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.schema import micros

# Keys that one round draws to choose its ranges from, and the ranges it counts.
SAMPLE, RANGES = 2048, 64


@dataclass(frozen=True)
class SortKey:
    """A column to sort by; NULL is less than any value, as in Spark's own order."""

    column: Column
    descending: bool = False

    @property
    def order(self) -> Column:
        return self.column.desc() if self.descending else self.column.asc()


def sort_keys(names: Sequence[str], descending: bool = False) -> list[SortKey]:
    return [SortKey(F.col(n), descending) for n in names]


def _comparable(df: DataFrame, key: SortKey) -> Column:
    """The key as something that compares alike and is safe to pass through the driver: times as integers."""
    kind = df.select(key.column).schema[0].dataType
    return micros(key.column) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else key.column


def _less(k: Column, v: object) -> Column:
    return F.lit(False) if v is None else F.coalesce(k < F.lit(v), F.lit(True))


def _more(k: Column, v: object) -> Column:
    return k.isNotNull() if v is None else F.coalesce(k > F.lit(v), F.lit(False))


def up_to(df: DataFrame, keys: Sequence[SortKey], values: Sequence[object]) -> Column:
    """Whether a row of `df` comes before the row with the comparable `values`, or is level with it."""
    here = F.lit(True)
    for key, v in reversed(list(zip(keys, values))):
        k = _comparable(df, key)
        here = (_more if key.descending else _less)(k, v) | (k.eqNullSafe(F.lit(v)) & here)
    return here


def rows_at(df: DataFrame, keys: Sequence[SortKey], start: int, size: int, most: int) -> DataFrame:
    """Rows `start` to `start + size - 1` (from 0) in the order of `keys`, which must leave no ties, sorted.

    Each round draws a fixed number of keys, counts the rows up to each of a few of them
    in one pass, and keeps the ranges that hold the slice: about one row in RANGES.
    Nothing is sorted or numbered until at most `most` rows (or a slice) are left.
    """
    inside, skip = df, start
    while True:
        named = {f"_k{i}": _comparable(inside, k) for i, k in enumerate(keys)}
        drawn = inside.select(*[c.alias(n) for n, c in named.items()]).orderBy(F.xxhash64(*named)).limit(SAMPLE)
        order = [F.col(n).desc() if k.descending else F.col(n).asc() for n, k in zip(named, keys)]
        points = [tuple(r) for r in drawn.orderBy(*order).collect()]
        if not points:
            return inside.limit(0)
        step = max(1, len(points) // RANGES)
        bounds = points[step - 1 :: step]
        counted = inside.agg(F.count("*").alias("n"), *[F.count_if(up_to(inside, keys, b)).alias(f"b{i}") for i, b in enumerate(bounds)]).first()
        n, upto = counted["n"], list(counted)[1:]
        below = max((i for i, c in enumerate(upto) if c <= skip), default=None)
        above = min((i for i, c in enumerate(upto) if c >= skip + size), default=None)
        first = 0 if below is None else upto[below]
        left = (n if above is None else upto[above]) - first
        narrow = inside
        if below is not None:
            narrow = narrow.where(~up_to(inside, keys, bounds[below]))
        if above is not None:
            narrow = narrow.where(up_to(inside, keys, bounds[above]))
        inside, skip = narrow, skip - first
        if left <= max(most, size) or left == n:
            return inside.orderBy(*[k.order for k in keys]).offset(skip).limit(size)


def rows_before(df: DataFrame, keys: Sequence[SortKey], n: int, most: int) -> DataFrame:
    """The first `n` rows in the order of `keys`, unsorted: a filter on the key of the last of them."""
    last = rows_at(df, keys, n - 1, 1, most).select(*[_comparable(df, k).alias(f"_k{i}") for i, k in enumerate(keys)]).first()
    return df if last is None else df.where(up_to(df, keys, tuple(last)))
