import math
import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import evaluate as E
from faultlens.operators.profile import histogram, label_correlation


def frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, score double")


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(1)
    return [(y, round(min(1, max(0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 2)) for y in (rnd.random() < 0.3 for _ in range(500))]


def test_auc_averages_ties(spark, pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(E.roc_auc(frame(spark, pairs)).first()["auc"], want)


def test_fbeta_takes_the_lowest_of_equal_cutoffs(spark, pairs):
    def fb(t):
        tp = sum(y and s >= t for y, s in pairs)
        p, r = tp / sum(s >= t for _, s in pairs), tp / sum(y for y, _ in pairs)
        return 5 * p * r / (4 * p + r + 1e-9)

    scores = sorted({s for _, s in pairs})
    best = max(scores, key=lambda t: (round(fb(t), 9), -t))
    got = E.fbeta_threshold(frame(spark, pairs)).first()
    assert got["threshold"] == best and math.isclose(got["fbeta"], fb(best), abs_tol=1e-8)
    tied = frame(spark, [(1, 0.9), (1, 0.9), (0, 0.1)])
    assert E.fbeta_threshold(tied).first()["threshold"] == 0.9


@pytest.mark.parametrize("only", [0, 1])
def test_one_class_has_no_auc(spark, only):
    r = E.roc_auc(frame(spark, [(only, 0.2), (only, 0.4)])).first()
    assert r["auc"] is None
    t = E.fbeta_threshold(frame(spark, [(only, 0.2), (only, 0.4)])).first()["threshold"]
    assert t is None if only == 0 else t == 0.2


def test_report_counts_undefined_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, pred int")
    got = {r["class"]: r for r in E.classification_report(df).collect()}
    assert got["1"]["precision"] == got["1"]["recall"] == got["1"]["f1"] == 0
    assert got["accuracy"]["f1"] == pytest.approx(2 / 3, abs=1e-6) and got["macro avg"]["support"] == 3
    assert E.f1_gate(df).first()["passed"] is False
    assert [tuple(r) for r in E.confusion_matrix(df).orderBy("y").collect()] == [(0, 2, 0), (1, 1, 0)]


def test_undefined_folds_are_counted_not_averaged(spark):
    folds = spark.createDataFrame([(0.5,), (0.7,), (None,)], "auc double")
    r = E.cv_summary(folds, ["auc"]).first()
    assert (r["mean"], r["std"], r["undefined_folds"]) == (0.6, 0.1, 1)


def test_fold_without_positives(spark):
    df = frame(spark, [(1, 0.9), (0, 0.1), (0, 0.2), (0, 0.6)]).withColumn("fold", (F.col("score") < 0.15).cast("int"))
    got = {r["fold"]: r for r in E.fold_metrics(df).collect()}
    assert got[1]["roc_auc"] is None and got[1]["threshold_f2"] is None and got[1]["f1_tuned"] == 0
    assert got[0]["n_train"] == 1 and got[0]["n_val"] == 3 and got[0]["roc_auc"] == 1.0


def test_error_threshold_needs_healthy_rows(spark):
    df = spark.createDataFrame([(1, 0.5)], "y int, error double")
    with pytest.raises(ValueError):
        E.error_threshold(df)
    assert E.separation(df).first()["separation_sigma"] is None


def test_parity_reports_the_gap(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "id int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, None)], "id int, v double")
    r = E.parity(a, b, ["id"], ["v"]).first()
    assert r["max_diff"] == 0.5 and not r["within"]
    assert E.parity(a, a, ["id"], ["v"]).first()["within"]


def test_correlation_with_gaps_and_flat_columns(spark):
    import numpy as np

    rnd = random.Random(3)
    data = [(None if i % 4 == 0 else rnd.random(), rnd.random(), 1.0, i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "gappy double, whole double, flat double, anomaly int")
    got = {r["column"]: r["r"] for r in label_correlation(df, ["gappy", "whole", "flat"]).collect()}
    known = [(a, d) for a, _, _, d in data if a is not None]
    assert got["gappy"] == pytest.approx(np.corrcoef(*zip(*known))[0, 1], abs=1e-6)
    assert got["whole"] == pytest.approx(np.corrcoef([b for _, b, _, _ in data], [d for *_, d in data])[0, 1], abs=1e-6)
    assert got["flat"] is None


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(61)] + [(None,)], "x double")
    got = {r["bin"]: r["n"] for r in histogram(df, ["x"]).collect()}
    assert sum(got.values()) == 61 and got[59] == 2


def test_scores_are_not_rounded(spark):
    df = frame(spark, [(1, 0.5000001), (0, 0.5000002), (1, 0.5000003), (0, 0.49999999)])
    assert E.roc_auc(df).first()["auc"] == 0.75


def test_curve_by_ranges_equals_one_window(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(2), rnd.gauss(0, 1e6), rnd.choice(["a", "b", None])) for _ in range(400)]
    df = spark.createDataFrame([*rows, (1, None, "a"), (0, 3.0, "c")], "y int, score double, fold string")
    whole = E.score_curve(df, by=["fold"]).toPandas()
    cut_ = E.score_curve(df, by=["fold"], range_rows=30).toPandas()
    key = ["fold", "threshold"]
    assert whole.sort_values(key).reset_index(drop=True).equals(cut_.sort_values(key).reset_index(drop=True))
    assert len(whole) == 401
