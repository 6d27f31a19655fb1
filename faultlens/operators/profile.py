"""Column profiles of a reading table, each in one or two passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.plans.quantiles import BUFFER_ROWS, exact_percentiles


def _long(row: DataFrame, columns: Sequence[str], name: str = "column") -> DataFrame:
    """A one-row frame of structs, one per column, turned into one row per column."""
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias("s")) for c in columns]))
    ).select(name, "s.*")


def describe_numeric(df: DataFrame, columns: Sequence[str], target_rows: int = BUFFER_ROWS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75], target_rows)

    def summary(c: str) -> Column:
        q25, q50, q75 = (F.lit(q).cast("double") for q in quartiles[c])
        return F.struct(
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            q25.alias("q25"),
            q50.alias("q50"),
            q75.alias("q75"),
            F.max(c).cast("double").alias("max"),
        ).alias(c)

    return _long(df.agg(*[summary(c) for c in columns]), columns)


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most common value (ties: smallest) and its frequency."""
    counts = _value_counts(df, columns)
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_unique"),
        F.max_by("value", _most_common()).alias("top"),
        F.max("n").alias("freq"),
    )


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and share of the columns that have any, worst first."""
    aggs = [
        F.struct(
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 4).alias("null_pct"),
        ).alias(c)
        for c in columns
    ]
    return _long(df.agg(*aggs), columns).where(F.col("n_null") > 0).orderBy(F.desc("n_null"), "column")


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per (column, value), nulls dropped, combined before the shuffle."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )


def _most_common() -> Column:
    """Orders by count; ties go to the smaller value (its bytes, complemented)."""
    inverse = F.translate(F.hex("value"), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.struct(F.col("n"), F.concat(inverse, F.lit("~")))


def column_purity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of the most common value per column, over all rows including nulls."""
    total = df.count()
    share = F.try_divide(F.col("top_n") * 100.0, F.lit(total))
    return (
        _value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.max_by("value", _most_common()).alias("top_value"),
            F.max("n").alias("top_n"),
            F.count("*").alias("n_distinct"),
        )
        .withColumn("pct", F.round(share, 4))
        .withColumn(
            "flag",
            F.when(F.col("top_n") == total, "constant").when(share > 99.9, "quasi-constant").otherwise("varying"),
        )
        .orderBy(F.desc("pct"), "column")
    )


def _pairwise(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[Column]:
    """Pearson correlation per pair as aggregates, NULL where a column has no spread.

    `corr` raises on a constant column under ANSI, so it is built from its parts. A
    first pass gives means and finds the columns with gaps. Pairs of complete columns
    share one centred square sum per column and need one product sum each; only pairs
    with gaps carry their own statistics over the rows where both are known.
    """
    columns = sorted({c for pair in pairs for c in pair})
    first = df.agg(
        F.count("*").alias("n"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.avg(c).alias(f"m_{c}") for c in columns],
    ).first()
    whole = {c for c in columns if first[f"n_{c}"] == first["n"] and first["n"]}

    def centred(c: str) -> Column:
        return F.col(c).cast("double") - F.lit(float(first[f"m_{c}"]))

    def ratio(top: Column, x: Column, y: Column) -> Column:
        return F.try_divide(top, F.nullif(F.sqrt(x) * F.sqrt(y), F.lit(0.0)))

    out = []
    for a, b in pairs:
        if a in whole and b in whole:
            out.append(
                ratio(F.sum(centred(a) * centred(b)), F.sum(centred(a) * centred(a)), F.sum(centred(b) * centred(b)))
            )
        else:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            out.append(ratio(F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)))
    return out


def label_correlation(df: DataFrame, columns: Sequence[str], label: str = "anomaly") -> DataFrame:
    r = _pairwise(df, [(c, label) for c in columns])
    row = df.agg(*[F.struct(F.round(x, 6).alias("r")).alias(c) for c, x in zip(columns, r)])
    return _long(row, columns).orderBy(F.desc_nulls_last("r"), "column")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in long form; the mirrored half is copied, not recomputed."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[x.alias(f"r{i}") for i, x in enumerate(_pairwise(df, pairs))])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in sorted({(a, b), (b, a)}):
            cells.append(
                F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.round(F.col(f"r{i}"), 6).alias("r"))
            )
    return row.select(F.inline(F.array(*cells)))


def top_correlations(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The `n` highest signed correlations of the upper triangle."""
    place = {c: i for i, c in enumerate(columns)}
    order = F.create_map(*[F.lit(v) for kv in place.items() for v in kv])
    upper = correlation_matrix(df, columns).where(F.element_at(order, F.col("a")) < F.element_at(order, F.col("b")))
    return upper.orderBy(F.desc_nulls_last("r"), "a", "b").limit(n)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 60) -> DataFrame:
    """Equal-width bins per column between its extremes; the last bin is closed."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]).first()
    known = [c for c in columns if row[c]["lo"] is not None]

    def bin_of(c: str) -> Column:
        lo, hi = row[c]["lo"], row[c]["hi"]
        if hi == lo:
            return F.when(F.col(c).isNotNull(), F.lit(bins // 2))
        place = F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / bins))
        # `least` skips NULL, so gaps are kept apart.
        return F.when(F.col(c).isNotNull(), F.least(place, F.lit(bins - 1)).cast("int"))

    cells = F.array(*[F.struct(F.lit(c).alias("column"), bin_of(c).alias("bin")) for c in known])
    return df.select(F.inline(cells)).where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(
        F.count("*").alias("n")
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5, target_rows: int = BUFFER_ROWS) -> DataFrame:
    """Quartiles, fences and the number of rows strictly outside, per column."""
    fences = {}
    for c, (q1, q3) in exact_percentiles(df, columns, [0.25, 0.75], target_rows).items():
        if q1 is not None:
            fences[c] = (q1, q3, q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
    aggs = [
        F.struct(
            F.round(F.lit(q1), 4).alias("q1"),
            F.round(F.lit(q3), 4).alias("q3"),
            F.round(F.lit(q3 - q1), 4).alias("iqr"),
            F.round(F.lit(low), 4).alias("lower_fence"),
            F.round(F.lit(high), 4).alias("upper_fence"),
            F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("n_outliers"),
            F.round(
                F.try_divide(F.count_if((F.col(c) < low) | (F.col(c) > high)) * 100.0, F.count("*")), 4
            ).alias("pct"),
        ).alias(c)
        for c, (q1, q3, low, high) in fences.items()
    ]
    return _long(df.agg(*aggs), list(fences), "sensor")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and the ratio of the largest class to the smallest."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    both = counts.agg(F.max("n").alias("hi"), F.min("n").alias("lo")).first()
    ratio = both["hi"] / both["lo"] if both["lo"] else None
    return counts.withColumn("imbalance", F.round(F.lit(ratio).cast("double"), 6))


def distinct_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.countDistinct(F.to_date(ts)).alias("n_days"))
