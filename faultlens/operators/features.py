"""Rolling, lagged and cross-sensor features of reading series.

Every feature looks at row positions, not at time distance, and only a bounded
number of rows back, so all of them share one `Series.roll`: one exchange, one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.plans.series import Series, lay_out
from faultlens.schema import ANALOGUE, DIGITAL, SENSORS, UNMODELLED, numeric_columns

RATIO_FLOOR = 1e-6
# Cross features, as (name, needed columns).
CROSS = {
    "TP2_TP3_diff": ("TP2", "TP3"),
    "TP2_TP3_ratio": ("TP2", "TP3"),
    "work_per_pressure": ("Motor_current", "TP2"),
    "reservoir_drop": ("Reservoirs", "TP3"),
}


@dataclass(frozen=True)
class FeatureSpec:
    """What to compute; the defaults are the model contract."""

    sensors: tuple[str, ...] = tuple(ANALOGUE)
    pressure: str = "TP2"
    window_std: int = 5
    window_ma_short: int = 5
    window_ma_long: int = 15
    v2: bool = True
    lag_short: int = 5
    lag_long: int = 15
    window_minmax: int = 15

    @property
    def lookback(self) -> int:
        frames = [self.window_std, self.window_ma_short, self.window_ma_long]
        if self.v2:
            frames += [self.window_minmax, self.lag_short + 1, self.lag_long + 1]
        return max(*frames, 2) - 1

    def present(self, df: DataFrame) -> list[str]:
        return [c for c in self.sensors if c in df.columns]


def delta(x: str, w: WindowSpec) -> Column:
    return F.coalesce(F.col(x) - F.lag(x, 1).over(w), F.lit(0.0))


def rolling_std(x: str, w: WindowSpec, rows: int) -> Column:
    return F.coalesce(F.stddev_samp(x).over(w.rowsBetween(1 - rows, 0)), F.lit(0.0))


def rolling_mean(x: str, w: WindowSpec, rows: int) -> Column:
    return F.avg(x).over(w.rowsBetween(1 - rows, 0))


def rate_of_change(x: str, back: str, rows: int) -> Column:
    return F.coalesce((F.col(x) - F.col(back)) / float(rows), F.lit(0.0))


def lagged(df: DataFrame, sensors: Sequence[str], lags: Sequence[int], w: WindowSpec, long: Column) -> DataFrame:
    """`{x}_lag_{n}`: the value n rows back; before that the first one of the series.

    A series of at most n rows has no value n rows back anywhere, so nothing can be
    filled from it and the lag stays NULL. Position, length and first values are
    computed once for all lags.
    """
    helpers = {
        "_pos": F.row_number().over(w),
        "_len": F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        **{f"_first_{x}": F.first(x).over(w.rowsBetween(W.unboundedPreceding, 0)) for x in sensors},
        **{f"_back_{x}_{n}": F.lag(x, n).over(w) for x in sensors for n in lags},
    }

    def value(x: str, n: int) -> Column:
        reachable = long | (F.col("_len") > n)
        return F.when(F.col("_pos") > n, F.col(f"_back_{x}_{n}")).when(reachable, F.col(f"_first_{x}"))

    out = df.withColumns(helpers).withColumns({f"{x}_lag_{n}": value(x, n) for x in sensors for n in lags})
    return out.drop(*helpers)


def cross_features(df: DataFrame) -> DataFrame:
    formulas = {
        "TP2_TP3_diff": lambda: F.col("TP2") - F.col("TP3"),
        "TP2_TP3_ratio": lambda: F.try_divide(F.col("TP2"), F.col("TP3") + RATIO_FLOOR),
        "work_per_pressure": lambda: F.try_divide(F.col("Motor_current"), F.col("TP2") + RATIO_FLOOR),
        "reservoir_drop": lambda: F.col("Reservoirs") - F.col("TP3"),
    }
    return df.withColumns(
        {name: formulas[name]() for name, needs in CROSS.items() if set(needs) <= set(df.columns)}
    )


def impute(
    df: DataFrame,
    key: str | Sequence[str] = (),
    order: Sequence[str] = ("ts", "event_id"),
    columns: Sequence[str] | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Fill gaps from the row before, leading gaps from the first known row."""
    keys = (key,) if isinstance(key, str) else tuple(key)
    columns = list(columns or numeric_columns(df, exclude=[*keys, *order]))
    return lay_out(df, key, order, target_rows).fill(columns, backward=True).rows


def build_features(df: DataFrame, w: WindowSpec, long: Column, spec: FeatureSpec) -> DataFrame:
    """Add the feature columns over an ordered window of (at least) the lookback."""
    sensors, added = spec.present(df), {}
    if spec.pressure in df.columns:
        added[f"{spec.pressure}_delta"] = delta(spec.pressure, w)
    for x in sensors:
        added[f"{x}_std_{spec.window_std}"] = rolling_std(x, w, spec.window_std)
    for x in sensors:
        for rows in (spec.window_ma_short, spec.window_ma_long):
            added[f"{x}_ma_{rows}"] = rolling_mean(x, w, rows)
    if spec.v2:
        frame = w.rowsBetween(1 - spec.window_minmax, 0)
        for x in sensors:
            added[f"{x}_min_{spec.window_minmax}"] = F.min(x).over(frame)
            added[f"{x}_max_{spec.window_minmax}"] = F.max(x).over(frame)
    df = df.withColumns(added)
    if not spec.v2:
        return df
    df = lagged(df, sensors, [spec.lag_short, spec.lag_long], w, long)
    derived = {}
    for x in sensors:
        derived[f"{x}_roc_{spec.lag_long}"] = rate_of_change(x, f"{x}_lag_{spec.lag_long}", spec.lag_long)
        low, high = f"{x}_min_{spec.window_minmax}", f"{x}_max_{spec.window_minmax}"
        derived[f"{x}_range_{spec.window_minmax}"] = F.col(high) - F.col(low)
    return cross_features(df).withColumns(derived)


def features_of(laid: Series, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    return laid.roll(spec.lookback, lambda df, w, long: build_features(df, w, long, spec)).rows


def add_features(
    df: DataFrame,
    key: str | Sequence[str] = (),
    order: Sequence[str] = ("ts", "event_id"),
    spec: FeatureSpec = FeatureSpec(),
    gaps: bool = True,
    target_rows: int | None = None,
) -> DataFrame:
    """All features of each series. Skip `gaps` when the sensors hold no NULL."""
    laid = lay_out(df, key, order, target_rows)
    if gaps:
        wanted = {*spec.sensors, *SENSORS, spec.pressure}
        laid = laid.fill([c for c in numeric_columns(df) if c in wanted], backward=True)
    return features_of(laid, spec)


def feature_names(v2: bool = True, spec: FeatureSpec | None = None) -> list[str]:
    """The 34-column (or, with `v2`, 80-column) model contract, in order."""
    s = spec or FeatureSpec(v2=v2)
    x = s.sensors
    names = [*SENSORS, f"{s.pressure}_delta"]
    names += [f"{c}_std_{s.window_std}" for c in x]
    names += [f"{c}_ma_{n}" for c in x for n in (s.window_ma_short, s.window_ma_long)]
    if v2:
        names += list(CROSS)
        for c in x:
            names += [f"{c}_lag_{s.lag_short}", f"{c}_lag_{s.lag_long}", f"{c}_roc_{s.lag_long}"]
        for c in x:
            names += [f"{c}_{f}_{s.window_minmax}" for f in ("min", "max", "range")]
    return names


def snapshot_features(df: DataFrame, sensors: Sequence[str] = ANALOGUE, pressure: str = "TP2") -> DataFrame:
    """Features of a reading without history: no change, no spread, mean = value."""
    added = {f"{pressure}_delta": F.lit(0.0)}
    for x in sensors:
        added[f"{x}_std_5"] = F.lit(0.0)
        added[f"{x}_ma_5"] = F.col(x).cast("double")
        added[f"{x}_ma_15"] = F.col(x).cast("double")
    return cross_features(df.withColumns(added))


def align(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly `names` in order: absent ones get their default, others are dropped."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            F.col(n) if n in have else F.lit(1.0 if n in UNMODELLED else 0.0).alias(n)
            for n in names
        ],
    )


def select_set(df: DataFrame, which: str, keep: Sequence[str] = ()) -> DataFrame:
    """A named feature set: `raw` (12 sensors), `v1` (34 columns) or `v2` (80)."""
    sets = {"raw": SENSORS, "v1": feature_names(False), "v2": feature_names(True)}
    if which not in sets:
        raise ValueError(f"unknown feature set {which!r}; choose from {sorted(sets)}")
    return df.select(*keep, *sets[which])


def validate_readings(df: DataFrame) -> DataFrame:
    """Add `is_valid` and `reasons`; the caller splits good rows from quarantine.

    The verdict is one plain predicate. The list of reasons is only built for rows
    that fail it.
    """
    known = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in SENSORS}
    inside = {c: F.col(c).between(0, 1) for c in DIGITAL}
    valid = reduce(and_, known.values()) & reduce(and_, inside.values())
    reasons = F.array_compact(
        F.array(
            *[F.when(~ok, F.lit(f"missing {c}")) for c, ok in known.items()],
            *[F.when(known[c] & ~ok, F.lit(f"{c} outside 0..1")) for c, ok in inside.items()],
        )
    )
    return df.withColumn("is_valid", valid).withColumn(
        "reasons", F.when(F.col("is_valid"), F.array().cast("array<string>")).otherwise(reasons)
    )


def drop_consecutive_repeats(
    df: DataFrame,
    key: str | Sequence[str],
    column: str = "ts",
    arrival: Sequence[str] = ("event_id",),
    target_rows: int | None = None,
) -> DataFrame:
    """Keep a row unless it repeats `column` of the row that arrived just before."""

    def build(rows: DataFrame, w: WindowSpec, long: Column) -> DataFrame:
        return rows.withColumn(
            "_repeat", F.lag(column).over(w).eqNullSafe(F.col(column)) & (F.lag(F.lit(1)).over(w).isNotNull())
        )

    laid = lay_out(df, key, arrival, target_rows)
    return laid.roll(1, build).rows.where(~F.col("_repeat")).drop("_repeat")


def warm_flag(
    df: DataFrame,
    key: str | Sequence[str] = "asset_id",
    order: Sequence[str] = ("ts", "event_id"),
    warm: int = 16,
    target_rows: int | None = None,
) -> DataFrame:
    """True once the series has shown `warm` readings."""
    out = lay_out(df, key, order, target_rows).index("_n").rows
    return out.withColumn("is_warm", F.col("_n") >= warm).drop("_n")
