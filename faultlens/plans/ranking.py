"""Seeded, reproducible ranks inside a class, without one window per class.

The order is that of md5(seed:id), so any engine can repeat it. Its leading hex
digits are uniform buckets: counting them gives each bucket's first rank, and only
rows of one bucket are sorted together, however large the class is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.plans.bounded import BROADCAST_ROWS
from faultlens.plans.series import cell_rows

# All hex digits of an md5.
MAX_DIGITS = 32


def seeded_hash(seed: int | str, *ids: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))


def seeded_integer(hashed: Column) -> Column:
    """The first 60 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")


def seeded_unit(hashed: Column) -> Column:
    """A uniform number in [0, 1) from a hex digest."""
    return seeded_integer(hashed) / F.lit(float(1 << 60))


def rank_in_class(
    df: DataFrame,
    by: str,
    ids: str,
    seed: int | str = 42,
    rank: str = "rank",
    total: str = "class_rows",
    target_rows: int | None = None,
) -> DataFrame:
    """Add the 0-based seeded rank of each row in its class, and the class's row count."""
    hashed = df.withColumn("_h", seeded_hash(seed, ids))
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    shape = sizes.agg(F.max("_n").alias("largest"), F.count("*").alias("classes"), F.sum("_n").alias("all")).first()
    largest, classes = shape["largest"] or 0, shape["classes"]
    target_rows = cell_rows(shape["all"] or 0, target_rows)
    if largest <= target_rows:
        whole = W.partitionBy(by)
        ordered = whole.orderBy("_h", ids)
        return hashed.withColumns(
            {
                rank: (F.row_number().over(ordered) - 1).cast("bigint"),
                total: F.count("*").over(whole),
            }
        ).drop("_h")
    digits = 1
    while largest > target_rows * 16**digits and digits < MAX_DIGITS:
        digits += 1
    # 16^digits buckets per class: about rows / target_rows of them.
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy(by, "_b").agg(F.count("*").alias("_rows"))
    whole = W.partitionBy(by)
    before = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col(by).alias("_c"),
        F.col("_b").alias("_cb"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(whole).alias(total),
    )
    if classes * 16**digits <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    inside = W.partitionBy(by, "_b").orderBy("_h", ids)
    return (
        hashed.join(starts, F.col(by).eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_cb")))
        .withColumn(rank, (F.row_number().over(inside) - 1 + F.col("_start")).cast("bigint"))
        .drop("_h", "_b", "_c", "_cb", "_start")
    )


def flag_lowest(
    df: DataFrame,
    by: str,
    ids: str,
    quota: Column,
    flag: str,
    seed: int | str = 42,
    target_rows: int | None = None,
) -> DataFrame:
    """Flag the `quota` rows of lowest seeded rank in each class, without moving the rows.

    `quota` is an expression of `class_rows`. Counting hash buckets tells in which
    bucket of a class the quota ends; sorting that bucket alone gives the hash where
    it ends, and the rows are then compared with it in place.
    """
    hashed = seeded_hash(seed, ids)
    narrow = df.select(F.col(by).alias("_class"), F.col(ids).alias("_id"), hashed.alias("_h"))
    sizes = narrow.groupBy("_class").agg(F.count("*").alias("_n"))
    shape = sizes.agg(F.max("_n").alias("largest"), F.count("*").alias("classes"), F.sum("_n").alias("all")).first()
    rows_each = cell_rows(shape["all"] or 0, target_rows)
    digits = 0
    while (shape["largest"] or 0) > rows_each * 16**digits and digits < MAX_DIGITS:
        digits += 1
    narrow = narrow.withColumn("_b", F.substring("_h", 1, digits))
    whole = W.partitionBy("_class")
    before = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        narrow.groupBy("_class", "_b")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_class",
            "_b",
            "_rows",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
            F.sum("_rows").over(whole).alias("class_rows"),
        )
        .withColumn("_quota", quota)
        .where((F.col("_start") <= F.col("_quota")) & (F.col("_quota") < F.col("_start") + F.col("_rows")))
        .select(F.col("_class").alias("_c"), F.col("_b").alias("_cb"), "_start", "_quota")
    )
    if shape["classes"] <= BROADCAST_ROWS:
        ends = F.broadcast(ends)  # one bucket per class
    inside = W.partitionBy("_class", "_b").orderBy("_h", "_id")
    limits = (
        narrow.join(ends, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_cb")))
        .withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_start"))
        .where(F.col("_rank") == F.col("_quota"))
        .select("_c", F.struct(F.col("_h"), F.col("_id")).alias("_limit"))
    )
    if shape["classes"] <= BROADCAST_ROWS:
        limits = F.broadcast(limits)  # one row per class
    below = F.struct(hashed.alias("_h"), F.col(ids).alias("_id")) < F.col("_limit")
    # No limit row: the quota covers the whole class.
    return (
        df.join(limits, F.col(by).eqNullSafe(F.col("_c")), "left")
        .withColumn(flag, F.coalesce(below, F.lit(True)))
        .drop("_c", "_limit")
    )
