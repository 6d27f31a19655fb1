"""Fixed-length sliding windows over series, and the tensors made from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.functions.scalar import blend
from faultlens.operators.labels import day_key
from faultlens.plans.bounded import small
from faultlens.plans.series import lay_out

LENGTH, STRIDE = 60, 10
PATCH, PATCH_STRIDE = 12, 6
RAMP_STEPS = 300


def window_count(rows: int, length: int = LENGTH, stride: int = STRIDE) -> int:
    """Number of complete windows; a series shorter than one window is an error."""
    n = (rows - length) // stride + 1 if rows >= length else 0
    if n <= 0:
        raise ValueError(f"{rows} rows give no window of {length}")
    return n


def sliding_windows(
    df: DataFrame,
    columns: Sequence[str],
    key: str | Sequence[str] = (),
    order: Sequence[str] = ("ts", "event_id"),
    length: int = LENGTH,
    stride: int = STRIDE,
    label: str | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """One row per complete window: `wid`, `first_<ts>`, `last_<ts>`, tensor `x`, label `y`.

    Rows are first packed into blocks of gcd(length, stride) rows, so each row is
    shuffled once instead of length / stride times; a window is then a run of
    neighbouring blocks. Runs are taken inside spans of blocks, and only the few
    blocks at the start of a span are copied to the span before it.
    """
    keys = (key,) if isinstance(key, str) else tuple(key)
    ts = order[0]
    size = gcd(length, stride)
    run = length // size
    span = run * 64
    rows = lay_out(df, key, order, target_rows).index("_rn", start=0).rows
    rows = rows.withColumn("_block", F.floor(F.col("_rn") / size))
    cells = F.struct("_rn", F.col(ts).alias("_t"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    y = F.max(F.col(label).cast("int")) if label else F.lit(None).cast("int")
    blocks = rows.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(cells)).alias("_rows"), y.alias("_y")
    )
    home = F.floor(F.col("_block") / span)
    shared = (F.pmod(F.col("_block"), F.lit(span)) < run - 1) & (home > 0)
    placed = blocks.withColumn("_home", home).withColumn(
        "_span", F.explode(F.when(shared, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    w = W.partitionBy(*keys, "_span").orderBy("_block").rowsBetween(0, run - 1)
    runs = (
        placed.withColumn("_win", F.flatten(F.collect_list("_rows").over(w)))
        .withColumn("y", F.max("_y").over(w))
        .where(F.col("_home") == F.col("_span"))
        .where(F.pmod(F.col("_block") * size, F.lit(stride)) == 0)
        .where(F.size("_win") == length)
    )
    out = runs.select(
        *keys,
        F.floor(F.col("_block") * size / stride).cast("bigint").alias("wid"),
        F.element_at("_win", 1)["_t"].alias(f"first_{ts}"),
        F.element_at("_win", -1)["_t"].alias(f"last_{ts}"),
        F.transform("_win", lambda r: r["_x"]).alias("x"),
        "y",
    )
    return out if label else out.drop("y")


def windows_by_day(windows: DataFrame, ts: str = "ts", drop_cross_day: bool = True) -> DataFrame:
    """Group key of each window: the day of its first row."""
    out = windows.withColumn("day", day_key(f"first_{ts}"))
    if drop_cross_day:
        out = out.where(F.col("day") == day_key(f"last_{ts}"))
    return out


def row_day(rn: str | Column, rows_per_day: int = 86_400) -> Column:
    """Day number by position, for series without timestamps."""
    return F.floor((F.col(rn) if isinstance(rn, str) else rn) / rows_per_day)


def healthy_windows(windows: DataFrame, y: str = "y") -> DataFrame:
    return windows.where(F.col(y) == 0)


def left_pad(x: str | Column, length: int = LENGTH) -> Column:
    """Repeat the oldest row in front of a short window; keep the newest of a long one."""
    x = F.col(x) if isinstance(x, str) else x
    short = F.concat(F.array_repeat(F.get(x, 0), F.lit(length) - F.size(x)), x)
    tail = F.slice(x, F.greatest(F.size(x) - (length - 1), F.lit(1)), length)
    return F.when(F.size(x) >= length, tail).when(F.size(x) > 0, short)


def channel(x: str | Column, i: int) -> Column:
    return F.transform(x, lambda row: F.element_at(row, i + 1))


def patches(
    x: str | Column, channels: int, length: int = LENGTH, patch: int = PATCH, stride: int = PATCH_STRIDE
) -> Column:
    """Overlapping patch tokens; each holds the patch of channel 0, then 1, ..."""
    n = (length - patch) // stride + 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda p: F.flatten(
            F.array(*[F.slice(channel(x, c), p * stride + 1, F.lit(patch)) for c in range(channels)])
        ),
    )


def flatten_window(x: str | Column) -> Column:
    return F.flatten(x)


def unflatten_window(v: str | Column, channels: int, length: int = LENGTH) -> Column:
    # `v` is an element of an array here, so that an expression is evaluated once and not for each of the rows.
    whole = F.array(F.col(v) if isinstance(v, str) else v)
    rows = F.sequence(F.lit(0), F.lit(length - 1))
    return F.get(F.transform(whole, lambda a: F.when(a.isNotNull(), F.transform(rows, lambda t: F.slice(a, t * channels + 1, F.lit(channels))))), F.lit(0))


def standardize_window(x: str | Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x - mean) / std per channel; a channel without spread is only centred."""
    return F.transform(
        x,
        lambda row: F.array(
            *[(F.element_at(row, c + 1) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in enumerate(zip(mean, std))]
        ),
    )


def drift_ramp(
    df: DataFrame,
    mode: str,
    key: str | Sequence[str] = (),
    order: Sequence[str] = ("ts", "event_id"),
    steps: int = RAMP_STEPS,
    target_rows: int | None = None,
) -> DataFrame:
    """`drift`: min(step / steps, 1), with the step restarting at each change of `mode`."""

    def mark(rows: DataFrame, w: WindowSpec, long: Column) -> DataFrame:
        changed = ~F.lag(mode).over(w).eqNullSafe(F.col(mode)) | F.lag(F.lit(1)).over(w).isNull()
        return rows.withColumn("_change", changed).withColumn("_since", F.when(F.col("_change"), F.col("_rn")))

    filled = lay_out(df, key, order, target_rows).index("_rn").roll(1, mark).fill(["_since"]).rows
    step = F.col("_rn") - F.col("_since") + 1
    return filled.withColumn("drift", F.least(step / F.lit(float(steps)), F.lit(1.0))).drop(
        "_rn", "_change", "_since"
    )


ZIP_BLOCK = 4096
COPIES_AT_ONCE = 10_000


def circular_blend(
    healthy: DataFrame,
    faulty: DataFrame,
    columns: Sequence[str],
    order: Sequence[str] = ("ts", "event_id"),
    steps: int = RAMP_STEPS,
    target_rows: int | None = None,
) -> DataFrame:
    """A series that drifts from healthy rows to faulty ones.

    Healthy row i meets faulty row i mod n_faulty; `step` is i + 1 and the blend
    weight min(step / steps, 1). The faulty rows are dealt out to blocks of healthy positions,
    each block getting those it meets, so that few faulty rows make no hot key.
    """
    n_faulty = faulty.count()
    if n_faulty == 0:
        faulty, n_faulty = healthy, healthy.count()
    a = lay_out(healthy, (), order, target_rows).index("_i", start=0).rows
    b = lay_out(faulty, (), order, target_rows).index("_j", start=0).rows
    b = b.select("_j", *[F.col(c).alias(f"_b_{c}") for c in columns])
    n_healthy, laps = healthy.count(), max(n_faulty, 1)
    # Of each faulty row one copy per block: all blocks if a block holds a lap, else those its laps fall in.
    copies = -(-n_healthy // max(ZIP_BLOCK, laps)) if n_healthy else 0
    b = b.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies // COPIES_AT_ONCE)))).repartition("_j", "_c")
    first = F.col("_c") * COPIES_AT_ONCE
    b = b.where(first < copies).withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.lit(copies)) - 1))).drop("_c")
    b = b.withColumn("_block", F.col("_copy").cast("long") if laps <= ZIP_BLOCK else F.floor((F.col("_j") + F.col("_copy").cast("long") * laps) / ZIP_BLOCK)).drop("_copy")
    placed = a.withColumns({"_j": F.pmod(F.col("_i"), F.lit(laps)), "_block": F.floor(F.col("_i") / ZIP_BLOCK)})
    joined = placed.join(b, ["_block", "_j"])
    drift = F.least((F.col("_i") + 1) / F.lit(float(steps)), F.lit(1.0))
    return joined.select(
        *order,
        (F.col("_i") + 1).alias("step"),
        drift.alias("drift"),
        *[blend(c, f"_b_{c}", drift).alias(c) for c in columns],
    )


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per channel, in long form."""
    stats = df.agg(
        *[
            F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("n")).alias(c)
            for c in columns
        ]
    )
    return stats.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std"), F.col(c)["n"].alias("n")) for c in columns])
        )
    )


def window_scaler(windows: DataFrame, channels: int, x: str = "x") -> tuple[list[float], list[float]]:
    """Mean and population deviation per channel over all rows of all windows.

    Rows shared by several windows count once per window. Each window is reduced to
    sums inside the expression, so no window is exploded; two numbers per channel
    come back to the driver.
    """
    spans = range(channels)

    def total(c: int, term: Callable[[Column], Column]) -> Column:
        return F.sum(F.aggregate(channel(x, c), F.lit(0.0), lambda s, a: s + term(a))).alias(f"c{c}")

    row = windows.agg(F.sum(F.size(x)).alias("n"), *[total(c, lambda a: a) for c in spans]).first()
    if not row["n"]:
        raise ValueError("no windows to fit the scaler on")
    mean = [row[f"c{c}"] / row["n"] for c in spans]

    def spread_from(m: float) -> Callable[[Column], Column]:
        return lambda a: (a - m) * (a - m)

    spread = windows.agg(*[total(c, spread_from(mean[c])) for c in spans]).first()
    return mean, [(spread[f"c{c}"] / row["n"]) ** 0.5 for c in spans]


def fit_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, as one small driver-side row."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardize_columns(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std with fitted statistics; no spread means only centring."""
    return df.withColumns(
        {
            c: F.lit(None).cast("double") if mean is None else (F.col(c) - F.lit(mean)) / F.lit(std or 1.0)
            for c, (mean, std) in stats.items()
        }
    )


def fold_of_window(windows: DataFrame, folds: DataFrame, on: str = "day") -> DataFrame:
    return windows.join(small(folds), on)
