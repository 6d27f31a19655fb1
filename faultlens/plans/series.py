"""Ordered work on time series of any length.

A window partitioned by asset puts a whole asset into one task. `lay_out` counts
the rows per series first. Series that fit a task keep the plain window. A longer
one is cut along its sort order into cells of about `target_rows` rows (by default a
size that depends on the row count); the cell
bounds are plain arithmetic on the sort columns, so no rows move to find them.

What crosses a cell border is passed on explicitly:

* rolling frames get the last rows of the cells before (`Series.roll`);
* fills and as-of lookups get one carried value per cell and column (`Series.fill`);
* row positions get the number of rows before the cell (`Series.index`);
* running sums and extremes get the result of the cells before (`Series.running`).

All of them give exactly what one window over the whole series would give, and they
chain: `lay_out(...).fill(...).roll(...).rows` lays the series out once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.plans.bounded import BROADCAST_ROWS, small
from faultlens.schema import micros
from faultlens.session import cut

# Rows per cell: enough to be worth a task, and never more than MAX_CELLS cells in all,
# so that the tables that describe cells stay small enough to broadcast.
MIN_CELL_ROWS = 250_000
MAX_CELLS = 400_000
# A cell may hold this many times the target before it is cut again.
SLACK = 4
MAX_LEVELS = 8

_ALL, _CELL, _OWN, _LONG = "_all", "_cell", "_own", "_long"


@dataclass(frozen=True)
class Series:
    """Rows of one or more series, with the columns that order them.

    `chunks` is None while every series fits one task; otherwise it has one row per
    cell of the long series: its row count and the number of rows before it.
    """

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    chunks: DataFrame | None = None
    n_cells: int = 0

    @property
    def rows(self) -> DataFrame:
        """The rows with the columns added so far, in no particular order."""
        return self.df.drop(_ALL, _CELL)

    def window(self) -> WindowSpec:
        cell = [_CELL] if self.chunks is not None else []
        return W.partitionBy(*self.key, *cell).orderBy(*self.order)

    def _per_cell(self, table: DataFrame) -> DataFrame:
        """A table of at most one row per cell, broadcast if it is measured to be small."""
        return small(table) if self.n_cells <= BROADCAST_ROWS else table

    def _on_cells(self, table: DataFrame) -> DataFrame:
        return join_on(self.df, self._per_cell(table), [*self.key, _CELL], "left")

    def roll(
        self,
        lookback: int,
        build: Callable[[DataFrame, WindowSpec, Column], DataFrame],
    ) -> Series:
        """Add columns that look at most `lookback` rows back.

        `build(df, w, long)` adds them over the window `w`; `long` tells the rows of
        series that were cut, where a count over `w` is not the series' row count.
        """
        w = self.window()
        if self.chunks is None:
            return replace(self, df=build(self.df, w, F.lit(False)))
        rows = self.df.withColumn(_OWN, F.lit(True)).unionByName(
            self._halo(lookback).withColumn(_OWN, F.lit(False))
        )
        rows = rows.withColumn(_LONG, F.size(_CELL) > 0)
        return replace(self, df=build(rows, w, F.col(_LONG)).where(_OWN).drop(_OWN, _LONG))

    def _halo(self, lookback: int) -> DataFrame:
        """The last `lookback` rows before each cell, moved into that cell."""
        after = W.partitionBy(*self.key).orderBy(_CELL).rowsBetween(1, lookback)
        end = F.col("_start") + F.col("_rows")
        # Each cell has a row, so only the next `lookback` cells can need this one.
        targets = self.chunks.select(
            *self.key,
            _CELL,
            F.transform(
                F.filter(
                    F.collect_list(F.struct(F.col("_start").alias("s"), F.col(_CELL).alias("c"))).over(after),
                    lambda x: x["s"] < end + lookback,
                ),
                lambda x: x["c"],
            ).alias("_to"),
        )
        backward = W.partitionBy(*self.key, _CELL).orderBy(*[F.desc(c) for c in self.order])
        tail = (
            self.df.where(F.size(_CELL) > 0)
            .withColumn("_back", F.row_number().over(backward))
            .where(F.col("_back") <= lookback)
            .drop("_back")
        )
        return (
            join_on(tail, self._per_cell(targets), [*self.key, _CELL], "inner")
            .withColumn(_CELL, F.explode("_to"))
            .drop("_to")
        )

    def fill(
        self, columns: Sequence[str], backward: bool = False, suffix: str = ""
    ) -> Series:
        """Carry the last known value forward; `backward` also fills the leading gap.

        After the forward step only rows before the first known value are open, so
        that one value, taken over the whole partition, closes the gap. A frame from
        the current row to the end would be evaluated anew for every row.
        """
        w = self.window()
        upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows, carried = self.df, {c: [F.lit(None), F.lit(None)] for c in columns}
        if self.chunks is not None:
            rows = self._on_cells(self._carry(columns))
            carried = {c: [F.col(f"_in_{c}"), F.col(f"_out_{c}")] for c in columns}
        filled = {}
        for c in columns:
            steps = [F.last(c, ignorenulls=True).over(upto), carried[c][0]]
            if backward:
                steps += [F.first(c, ignorenulls=True).over(whole), carried[c][1]]
            filled[c + suffix] = F.coalesce(*steps)
        out = rows.withColumns(filled)
        return replace(self, df=out.drop(*[f"_{d}_{c}" for d in ("in", "out") for c in columns]))

    def _carry(self, columns: Sequence[str]) -> DataFrame:
        at = F.struct(*self.order)
        ends = []
        for c in columns:
            known = F.col(c).isNotNull()
            ends += [
                F.max_by(c, F.when(known, at)).alias(f"_last_{c}"),
                F.min_by(c, F.when(known, at)).alias(f"_first_{c}"),
            ]
        cells = self.df.where(F.size(_CELL) > 0).groupBy(*self.key, _CELL).agg(*ends)
        w = W.partitionBy(*self.key).orderBy(_CELL)
        before = w.rowsBetween(W.unboundedPreceding, -1)
        after = w.rowsBetween(1, W.unboundedFollowing)
        return cut(
            cells.select(
                *self.key,
                _CELL,
                *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns],
                *[F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_out_{c}") for c in columns],
            )
        )

    def index(self, name: str = "rn", start: int = 1) -> Series:
        """Dense row position within the series, counted from `start`."""
        position = F.row_number().over(self.window()) + (start - 1)
        if self.chunks is None:
            return replace(self, df=self.df.withColumn(name, position.cast("bigint")))
        rows = self._on_cells(self.chunks.drop("_rows"))
        position = position + F.coalesce(F.col("_start"), F.lit(0))
        return replace(self, df=rows.withColumn(name, position.cast("bigint")).drop("_start"))

    def running(self, column: str, how: str, name: str, exclusive: bool = False) -> Series:
        """Running `sum`, `max` or `min` from the start of the series."""
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
        upto = self.window().rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        here = agg(column).over(upto)
        if self.chunks is None:
            return replace(self, df=self.df.withColumn(name, here))
        cells = self.df.where(F.size(_CELL) > 0).groupBy(*self.key, _CELL).agg(agg(column).alias("_total"))
        before = W.partitionBy(*self.key).orderBy(_CELL).rowsBetween(W.unboundedPreceding, -1)
        carried = cut(cells.select(*self.key, _CELL, agg("_total").over(before).alias("_before")))
        merge = {
            "sum": lambda a, b: F.coalesce(a + b, a, b),
            "max": lambda a, b: F.greatest(a, b),  # both skip NULL
            "min": lambda a, b: F.least(a, b),
        }[how]
        rows = self._on_cells(carried)
        return replace(self, df=rows.withColumn(name, merge(here, F.col("_before"))).drop("_before"))


def join_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, where NULL equals NULL: a series may have no key."""
    own = {c: f"_right_{i}" for i, c in enumerate(names)}
    renamed = right.withColumnsRenamed(own)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(r)) for c, r in own.items()])
    return left.join(renamed, same, how).drop(*own.values())


def cell_rows(total: int, wanted: int | None = None) -> int:
    """Rows per cell for a table of `total` rows, unless the caller wants a given size."""
    return wanted or max(MIN_CELL_ROWS, -(-total // MAX_CELLS))


def _axes(df: DataFrame, order: Sequence[str]) -> dict[str, Column]:
    """Sort columns as integers; splitting stops at the first that has no such form."""
    axes: dict[str, Column] = {}
    for name in order:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            axes[name] = micros(name)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            axes[name] = F.col(name).cast("bigint")
        else:
            break
    return axes


def lay_out(
    df: DataFrame,
    key: str | Sequence[str] = (),
    order: Sequence[str] = ("ts", "event_id"),
    target_rows: int | None = None,
) -> Series:
    """Decide how the series of `df` are spread over tasks (runs one narrow count).

    `order` must sort the rows of a series without ties. With an empty `key` the
    whole table is one series.
    """
    key = (key,) if isinstance(key, str) else tuple(key)
    if not key:
        df, key = df.withColumn(_ALL, F.lit(0)), (_ALL,)
    axes = _axes(df, order)
    if not axes:
        raise TypeError(f"the first sort column {order[0]!r} must be a time or an integer")

    def ranges(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        spans = [
            F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(f"_r{i}")
            for i, a in enumerate(axes.values())
        ]
        return rows.groupBy(*by).agg(F.count("*").alias("_rows"), *spans)

    sizes = df.groupBy(*key).agg(F.count("*").alias("_n"))
    shape = sizes.agg(F.max("_n").alias("top"), F.sum("_n").alias("all")).first()
    target_rows = cell_rows(shape["all"] or 0, target_rows)
    if (shape["top"] or 0) <= target_rows:
        return Series(df, key, tuple(order))

    rows = df.withColumn(_CELL, F.array().cast("array<bigint>"))
    crowded = cut(ranges(rows, [*key, _CELL]).where(F.col("_rows") > target_rows))
    for _ in range(MAX_LEVELS):
        rows = _cut_again(rows, crowded, key, axes, target_rows)
        cells = cut(ranges(rows.where(F.size(_CELL) > 0), [*key, _CELL]))
        crowded = cells.where(F.col("_rows") > SLACK * target_rows).where(_splittable(axes))
        if crowded.isEmpty():
            break
    before = W.partitionBy(*key).orderBy(_CELL).rowsBetween(W.unboundedPreceding, -1)
    chunks = cells.select(*key, _CELL, "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return Series(rows, key, tuple(order), chunks, cells.count())


def _splittable(axes: dict[str, Column]) -> Column:
    """True where some sort column still varies inside the cell."""
    return reduce(or_, [F.col(f"_r{i}.hi") > F.col(f"_r{i}.lo") for i in range(len(axes))])


def _cut_again(
    rows: DataFrame, crowded: DataFrame, key: Sequence[str], axes: dict[str, Column], target_rows: int
) -> DataFrame:
    """Lengthen the cell path of rows in crowded cells by one equal-width step.

    The first sort column that still varies inside a cell is the one to cut.
    """
    axis = F.coalesce(
        *[F.when(F.col(f"_r{i}.hi") > F.col(f"_r{i}.lo"), F.lit(i)) for i in range(len(axes))]
    )
    span = F.element_at(F.array(*[F.col(f"_r{i}") for i in range(len(axes))]), F.col("_axis") + 1)
    # As doubles: monotone, and the span of two BIGINTs cannot overflow.
    lo, hi = span["lo"].cast("double"), span["hi"].cast("double")
    pieces = F.ceil(F.col("_rows") / F.lit(target_rows))
    grid = (
        crowded.withColumn("_axis", axis)
        .where(F.col("_axis").isNotNull())
        .select(*key, _CELL, "_axis", lo.alias("_lo"), (F.floor((hi - lo) / pieces) + 1.0).alias("_width"))
    )
    at = F.lit(None).cast("bigint")
    for i, a in reversed(list(enumerate(axes.values()))):
        at = F.when(F.col("_axis") == i, a).otherwise(at)
    step = F.floor((at.cast("double") - F.col("_lo")) / F.col("_width"))
    path = F.when(F.col("_axis").isNotNull(), F.concat(_CELL, F.array(step))).otherwise(F.col(_CELL))
    return (
        join_on(rows, small(grid), [*key, _CELL], "left").withColumn(_CELL, path).drop("_axis", "_lo", "_width")
    )
