"""Metrics of binary fault scores, exact in definition and built from native aggregates.

Score curves need a running sum over scores in descending order. Rows are counted per
distinct score first. If those are few, one window sums them; else they are dealt to
tasks by range of score, and a task starts from the totals of the ranges above its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.plans.bounded import small
from faultlens.plans.quantiles import BUFFER_ROWS, exact_percentiles
from faultlens.plans.series import join_on
from faultlens.session import cut

# Distinct scores that one task sums up.
RANGE_ROWS = 250_000
GATE_F1 = 0.75


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Rows are true classes; columns `pred_0` and `pred_1` count the predictions."""
    return (
        df.groupBy(F.col(y).alias("y"))
        .pivot(pred, [0, 1])
        .count()
        .select("y", *[F.coalesce(F.col(str(p)), F.lit(0)).cast("bigint").alias(f"pred_{p}") for p in (0, 1)])
    )


def outcome_counts(y: str, pred: str) -> list[Column]:
    t, p = F.col(y) == 1, F.col(pred) == 1
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    ]


def f1_of_counts() -> Column:
    return _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, f1 and support, then accuracy and both averages.

    A quotient without denominator counts as 0.
    """
    c = df.groupBy(*by).agg(*outcome_counts(y, pred))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        p, r = _ratio(hit * 1.0, hit + wrong), _ratio(hit * 1.0, hit + missed)
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            _ratio(2.0 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    both = c.select(*by, line("0", tn, fn, fp).alias("a"), line("1", tp, fp, fn).alias("b"), _ratio((tp + tn) * 1.0, tp + fp + fn + tn).alias("acc"))
    n = F.col("a.support") + F.col("b.support")

    def mean(name: str, weighted: bool) -> Column:
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        if weighted:
            return _ratio(a * F.col("a.support") + b * F.col("b.support"), n)
        return (a + b) / 2

    def average(name: str, weighted: bool) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[mean(m, weighted).alias(m) for m in ("precision", "recall", "f1")],
            n.alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("class"), *[F.col("acc").alias(m) for m in ("precision", "recall", "f1")], n.alias("support")
    )
    lines = F.array(F.col("a"), F.col("b"), accuracy, average("macro avg", False), average("weighted avg", True))
    return both.select(*by, F.inline(lines)).withColumns(
        {m: F.round(m, 6) for m in ("precision", "recall", "f1")}
    )


def f1_gate(df: DataFrame, y: str = "y", pred: str = "pred", gate: float = GATE_F1) -> DataFrame:
    f1 = f1_of_counts()
    return df.agg(*outcome_counts(y, pred)).select(F.round(f1, 6).alias("f1"), (f1 >= gate).alias("passed"))


def score_groups(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """True and false counts per distinct score."""
    return (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(y) == 1).alias("tp_here"), F.count_if(F.col(y) != 1).alias("fp_here"))
    )


def score_curve(
    df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Per distinct cut-off (score >= threshold): cumulative counts, precision, recall."""
    groups = score_groups(df, y, score, by)
    # The counted table is stored: its ranges must not be drawn anew, and it is read several times.
    groups = cut(groups)
    n = groups.count()
    ranges = -(-n // range_rows)
    if ranges > 1:
        groups = cut(groups.repartitionByRange(ranges, F.desc("threshold")).withColumn("_range", F.spark_partition_id()))
    else:
        groups = groups.withColumn("_range", F.lit(0))
    part = list(by)
    sums = [F.sum("tp_here").alias("tp"), F.sum("fp_here").alias("fp")]
    above = W.partitionBy(*part).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*part)
    zero = F.lit(0).cast("bigint")
    totals = groups.groupBy(*part, "_range").agg(*sums).select(
        *part,
        "_range",
        F.coalesce(F.sum("tp").over(above), zero).alias("_tp"),
        F.coalesce(F.sum("fp").over(above), zero).alias("_fp"),
        F.sum("tp").over(whole).alias("positives"),
        F.sum("fp").over(whole).alias("negatives"),
    )
    down = W.partitionBy(*part, "_range").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    curve = join_on(groups, small(totals), [*part, "_range"], "inner").select(
        *part,
        "threshold",
        "tp_here",
        "fp_here",
        (F.sum("tp_here").over(down) + F.col("_tp")).alias("cum_tp"),
        (F.sum("fp_here").over(down) + F.col("_fp")).alias("cum_fp"),
        "positives",
        "negatives",
    )
    tp, fp = F.col("cum_tp"), F.col("cum_fp")
    return curve.withColumns(
        {"precision": _ratio(tp * 1.0, tp + fp), "recall": F.try_divide(tp * 1.0, F.col("positives"))}
    )


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    return score_curve(df, y, score).select(
        "threshold", "cum_tp", "cum_fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


def _area() -> Column:
    """Area under the curve with tied scores averaged; NULL when one class is absent."""
    area = F.sum(F.col("fp_here") * (F.col("cum_tp") - F.col("tp_here") / 2))
    pairs = F.max("positives") * F.max("negatives").cast("double")
    return F.try_divide(area, F.nullif(pairs, F.lit(0.0)))


def _best_point(beta: float) -> Column:
    """The point of the highest F-beta, among equals that of the lowest cut-off; NULL without positives."""
    p, r, b2 = F.col("precision"), F.col("recall"), beta * beta
    f = F.when(F.col("positives") > 0, F.round((1 + b2) * p * r / (b2 * p + r + 1e-9), 9))
    point = F.struct("threshold", "precision", "recall", f.alias("fbeta"), "cum_tp", "cum_fp")
    return F.max_by(F.when(f.isNotNull(), point), F.struct(f.alias("f"), (-F.col("threshold")).alias("low")))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area with tied scores averaged; NULL when one class is absent."""
    return score_curve(df, y, score, by).groupBy(*by).agg(
        _area().alias("auc"),
        F.coalesce(F.max("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.max("negatives"), F.lit(0)).alias("negatives"),
    )


def fbeta_threshold(
    df: DataFrame, y: str = "y", score: str = "score", beta: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """The cut-off with the highest F-beta; among equals the lowest one.

    Without positives no cut-off is meaningful and the threshold is NULL.
    """
    best = score_curve(df, y, score, by).groupBy(*by).agg(_best_point(beta).alias("best"))
    return best.select(*by, *[f"best.{c}" for c in ("threshold", "precision", "recall", "fbeta")])


def cv_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds, and how many folds had no value."""
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.round(F.avg(m), 4).alias("mean"),
                F.round(F.stddev_pop(m), 4).alias("std"),
                F.count_if(F.col(m).isNull()).alias("undefined_folds"),
            )
            for m in metrics
        ]
    )
    return folds.agg(cells.alias("m")).select(F.inline("m"))


def error_threshold(
    df: DataFrame, error: str = "error", y: str = "y", percentile: float = 99.0, target_rows: int = BUFFER_ROWS
) -> float:
    """Percentile of the error over healthy windows; without any it is undefined."""
    value = exact_percentiles(df.where(F.col(y) == 0), [error], [percentile / 100], target_rows)[error][0]
    if value is None:
        raise ValueError("no healthy windows to set the threshold on")
    return value


def separation(df: DataFrame, error: str = "error", y: str = "y") -> DataFrame:
    """Distance of the mean errors in healthy deviations; NULL without anomalies."""
    ok, bad = F.when(F.col(y) == 0, F.col(error)), F.when(F.col(y) == 1, F.col(error))
    return df.agg(
        F.avg(ok).alias("healthy_mean"),
        F.stddev_pop(ok).alias("healthy_std"),
        F.avg(bad).alias("anomaly_mean"),
    ).withColumn(
        "separation_sigma",
        (F.col("anomaly_mean") - F.col("healthy_mean")) / (F.col("healthy_std") + 1e-8),
    )


def timing_percentiles(df: DataFrame, ms: str = "ms") -> DataFrame:
    p50, p95 = exact_percentiles(df, [ms], [0.5, 0.95])[ms]
    return df.agg(
        F.count(ms).alias("n"),
        F.round(F.lit(p50).cast("double"), 3).alias("p50_ms"),
        F.round(F.lit(p95).cast("double"), 3).alias("p95_ms"),
    )


def window_mse(x: str | Column, reconstruction: str | Column) -> Column:
    """Mean squared difference of two T x C arrays."""
    flat = F.zip_with(F.flatten(x), F.flatten(reconstruction), lambda a, b: (a - b) * (a - b))
    return F.aggregate(flat, F.lit(0.0), lambda s, d: s + d) / F.size(F.flatten(x))


def parity(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Largest difference per column of two outputs matched by row key."""
    left = a.select(*on, *[F.col(c).alias(f"_a_{c}") for c in columns])
    right = b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in columns])
    cells = []
    for c in columns:
        gap = F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")))
        one_sided = F.count_if(F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull())
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count("*").alias("n"),
                F.coalesce(gap, F.lit(0.0)).alias("max_diff"),
                (F.coalesce(gap <= tolerance, F.lit(True)) & (one_sided == 0)).alias("within"),
            )
        )
    return left.join(right, list(on)).agg(F.array(*cells).alias("m")).select(F.inline("m"))


def fold_metrics(df: DataFrame, fold: str = "fold", y: str = "y", score: str = "score", cut: float = 0.5) -> DataFrame:
    """One row per fold: sizes, class weight, F1 at `cut`, AUC, F2 cut-off, tuned F1.

    `df` holds each row once, with the fold it is validated in; it is read once, and
    all figures follow from the counts per fold and score. Rows without a score or
    label count in no figure. A NULL fold is a fold.
    """
    curve = score_curve(df, y, score, [fold])
    hit = F.col("threshold") >= cut

    def f1(tp: Column, fp: Column) -> Column:
        return _ratio(2.0 * tp, tp + fp + F.col("pos"))

    per_fold = curve.groupBy(fold).agg(
        F.max("positives").alias("pos"),
        (F.max("positives") + F.max("negatives")).alias("n_val"),
        F.coalesce(F.max(F.when(hit, F.col("cum_tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.max(F.when(hit, F.col("cum_fp"))), F.lit(0)).alias("fp"),
        _area().alias("auc"),
        _best_point(2.0).alias("best"),
    )
    everything = W.partitionBy(F.lit(0))  # one row per fold
    train = F.sum("n_val").over(everything) - F.col("n_val")
    train_pos = F.sum("pos").over(everything) - F.col("pos")
    zero = F.lit(0)
    return per_fold.select(
        fold,
        train.alias("n_train"),
        "n_val",
        F.round((train - train_pos) / F.greatest(F.lit(1), train_pos), 4).alias("pos_weight"),
        F.round(f1(F.col("tp"), F.col("fp")), 4).alias("f1_default"),
        F.round("auc", 4).alias("roc_auc"),
        F.round("best.threshold", 4).alias("threshold_f2"),
        F.round(f1(F.coalesce("best.cum_tp", zero), F.coalesce("best.cum_fp", zero)), 4).alias("f1_tuned"),
    )
