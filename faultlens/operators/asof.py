"""As-of joins: each left row takes the newest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.plans.series import lay_out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: Sequence[str],
    ts: str = "ts",
    left_id: str = "event_id",
    right_id: str = "event_id",
    allow_equal: bool = True,
    target_rows: int | None = None,
) -> DataFrame:
    """Left rows with `columns` of their newest earlier right row (NULL if none).

    Both sides are stacked and the right row is carried forward along the key's
    series: one shuffle on the key, linear work, no range comparison of pairs.
    Among right rows of one instant the largest id wins. A NULL key matches nothing.
    """
    keyless = left.where(F.col(key).isNull())
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    right_side, left_side = (0, 1) if allow_equal else (1, 0)
    match = F.struct(*[F.col(c) for c in columns])
    stacked = left.select(
        key,
        ts,
        F.lit(left_side).alias("_side"),
        F.col(left_id).alias("_id"),
        F.struct(*[c for c in left.columns if c not in (key, ts)]).alias("_left"),
    ).unionByName(
        right.select(
            key, ts, F.lit(right_side).alias("_side"), F.col(right_id).alias("_id"), match.alias("_match")
        ),
        allowMissingColumns=True,
    )
    laid = lay_out(stacked, key, (ts, "_side", "_id"), target_rows)
    found = laid.fill(["_match"]).rows.where(F.col("_side") == left_side)
    unmatched = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    others = [c for c in left.columns if c not in (key, ts)]
    return found.select(key, ts, "_left.*", "_match.*").union(keyless.select(key, ts, *others, *unmatched))
