"""Exact percentiles (linear interpolation) that do not gather a column in one task.

Spark's `percentile` keeps every distinct value of a group in one buffer. That is
fine up to `target_rows`; beyond it each wanted order statistic is enclosed between
two approximate percentiles, whose exact ranks are then counted, for all statistics
together. A step leaves about one row in a thousand, however the values are spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Up to this many rows, Spark's own aggregate holds the values of a column.
BUFFER_ROWS = 1_000_000
# Ranks of approximate percentiles are off by at most one part in ACCURACY.
ACCURACY = 10_000
# Between bounds with at most this many rows values are sorted outright.
SORT_ROWS = 50_000


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], fractions: Sequence[float], target_rows: int = BUFFER_ROWS
) -> dict[str, list[float | None]]:
    """Percentiles per column over its known values; None for a column without any."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    df = df.select(*[x.alias(c) for c, x in known.items()])
    row = df.agg(*[F.struct(F.count(c).alias("n")).alias(c) for c in columns]).first()
    if max((row[c]["n"] for c in columns), default=0) <= target_rows:
        points = F.array(*[F.lit(float(p)) for p in fractions])
        out = df.agg(*[F.percentile(c, points).alias(c) for c in columns]).first()
        return {c: list(out[c]) if out[c] is not None else [None] * len(fractions) for c in columns}

    wanted: dict[tuple[str, int], list] = {}
    for c in columns:
        n = row[c]["n"]
        for p in fractions if n else []:
            at = (n - 1) * p
            for rank in {floor(at), ceil(at)}:
                # Rank between the bounds, the bounds (outside of them), and the rows between.
                wanted[c, rank] = [rank, None, None, n]
    values = _select(df, wanted, min(SORT_ROWS, target_rows))

    def interpolate(c: str, p: float) -> float | None:
        n = row[c]["n"]
        if not n:
            return None
        at = (n - 1) * p
        low, high = floor(at), ceil(at)
        if low == high:
            return values[c, low]
        return (high - at) * values[c, low] + (at - low) * values[c, high]

    return {c: [interpolate(c, p) for p in fractions] for c in columns}


def _between(c: str, lo: float | None, hi: float | None) -> Column:
    inside = F.col(c).isNotNull()
    if lo is not None:
        inside = inside & (F.col(c) > F.lit(lo))
    if hi is not None:
        inside = inside & (F.col(c) < F.lit(hi))
    return inside


def _select(df: DataFrame, wanted: dict[tuple[str, int], list], sort_rows: int) -> dict[tuple[str, int], float]:
    """Each step finds a statistic or moves it strictly between two values it counted."""
    found: dict[tuple[str, int], float] = {}
    while wanted:
        short = [k for k, v in wanted.items() if v[3] <= sort_rows]
        if short:
            inside = [F.when(_between(k[0], *wanted[k][1:3]), F.col(k[0])) for k in short]
            got = df.agg(*[F.element_at(F.sort_array(F.collect_list(x)), wanted[k][0] + 1).alias(f"v{i}") for i, (k, x) in enumerate(zip(short, inside))]).first()
            for i, k in enumerate(short):
                found[k] = got[i]
                del wanted[k]
            continue
        targets = list(wanted)
        pivots = []
        for c, rank in targets:
            at, lo, hi, n = wanted[c, rank]
            near = F.array(*[F.lit(min(1.0, max(0.0, at / n + d / ACCURACY))) for d in (-2, 2)])
            pivots.append(F.percentile_approx(F.when(_between(c, lo, hi), F.col(c)), near, ACCURACY))
        bounds = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(pivots)]).first()
        counts = []
        for i, k in enumerate(targets):
            _, lo, hi, _n = wanted[k]
            a, b = bounds[i]
            x, inside = F.col(k[0]), _between(k[0], lo, hi)
            tests = {"under": x < F.lit(a), "low": x == F.lit(a), "mid": (x > F.lit(a)) & (x < F.lit(b)), "high": x == F.lit(b)}
            counts.append(F.struct(*[F.count_if(inside & t).alias(n) for n, t in tests.items()]).alias(f"c{i}"))
        row = df.agg(*counts).first()
        for i, k in enumerate(targets):
            rank, lo, hi, n = wanted[k]
            a, b = bounds[i]
            c = row[i]
            up_to = {"under": c["under"], "low": c["under"] + c["low"]}
            high_from = up_to["low"] + c["mid"]
            if rank < up_to["under"]:
                wanted[k] = [rank, lo, a, c["under"]]
            elif rank < up_to["low"]:
                found[k] = a
                del wanted[k]
            elif rank < high_from:
                wanted[k] = [rank - up_to["low"], a, b, c["mid"]]
            elif a != b and rank < high_from + c["high"]:
                found[k] = b
                del wanted[k]
            else:
                past = high_from + (c["high"] if a != b else 0)
                wanted[k] = [rank - past, b, hi, n - past]
    return found
