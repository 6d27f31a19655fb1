import math
import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import features as X
from faultlens.operators.scoring import SensorFeatures
from faultlens.schema import ANALOGUE, DIGITAL, SENSORS, MissingColumns, nan_to_null, project_contract


def frame(spark, n, **fixed):
    """n readings one second apart; `fixed` maps a sensor to a function of the row number."""
    rnd = random.Random(42)
    rows = []
    for i in range(n):
        values = [fixed[c](i) if c in fixed else rnd.uniform(0.5, 10) for c in ANALOGUE]
        rows.append((i, *[None if v is None else float(v) for v in values], *[float(i % 2)] * 5))
    names = ["event_id", *ANALOGUE, *DIGITAL]
    df = spark.createDataFrame(rows, ", ".join(["event_id bigint"] + [f"{c} double" for c in names[1:]]))
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    return df.withColumn("ts", start + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)")))


def collect(df):
    return [r.asDict() for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize("n", [1, 10, 40])
def test_shape_and_first_row(spark, n):
    raw = frame(spark, n)
    out = collect(X.add_features(raw))
    assert len(out) == n
    assert set(X.feature_names(True)) <= set(out[0])
    assert len(X.feature_names(True)) == 80 and len(X.feature_names(False)) == 34
    assert out[0]["TP2_delta"] == 0 and out[0]["TP2_std_5"] == 0 and out[0]["TP2_roc_15"] == 0
    assert [r["TP2"] for r in out] == [r["TP2"] for r in collect(raw)]


def test_lags_and_rates(spark):
    out = collect(X.add_features(frame(spark, 40)))
    x = [r["TP2"] for r in out]
    assert out[20]["TP2_lag_5"] == x[15] and out[20]["TP2_lag_15"] == x[5]
    assert out[3]["TP2_lag_5"] == x[0]
    assert math.isclose(out[30]["TP2_roc_15"], (x[30] - x[15]) / 15)
    for r in out:
        assert math.isclose(r["TP2_range_15"], r["TP2_max_15"] - r["TP2_min_15"]) and r["TP2_range_15"] >= 0


def test_lag_stays_null_in_a_short_series(spark):
    out = collect(X.add_features(frame(spark, 10)))
    assert all(r["TP2_lag_15"] is None and r["TP2_roc_15"] == 0 for r in out)
    assert out[0]["TP2_lag_5"] == out[0]["TP2"]


@pytest.mark.parametrize(
    "gap, want", [(range(3, 6), [1, 2, 3, 3, 3, 3, 7]), (range(0, 3), [4, 4, 4, 4, 5, 6, 7])]
)
def test_gaps_are_filled(spark, gap, want):
    df = frame(spark, 7, TP2=lambda i: None if i in gap else i + 1)
    assert [r["TP2"] for r in collect(X.impute(df, columns=["TP2"]))] == want


def test_all_null_stays_null_and_nan_counts_as_missing(spark):
    df = frame(spark, 5, TP2=lambda i: None, TP3=lambda i: float("nan") if i == 2 else i)
    out = collect(X.impute(nan_to_null(df), columns=["TP2", "TP3"]))
    assert all(r["TP2"] is None for r in out)
    assert [r["TP3"] for r in out] == [0, 1, 1, 3, 4]


def test_short_mean_follows_a_step_faster(spark):
    out = collect(X.add_features(frame(spark, 40, TP2=lambda i: 1 + 100 * (i >= 20))))
    assert out[22]["TP2_ma_5"] > out[22]["TP2_ma_15"]


def test_ratio_is_finite_at_zero(spark):
    out = collect(X.add_features(frame(spark, 20, TP3=lambda i: 0)))
    assert all(math.isfinite(r["TP2_TP3_ratio"]) for r in out)
    edge = collect(X.cross_features(frame(spark, 2, TP3=lambda i: -1e-6)))
    assert edge[0]["TP2_TP3_ratio"] is None


def test_absent_sensors_are_skipped(spark):
    out = X.add_features(frame(spark, 20).drop("H1", "TP3"))
    assert not any(c.startswith("H1") for c in out.columns)
    assert "TP2_TP3_ratio" not in out.columns and "work_per_pressure" in out.columns


def test_cut_series_give_the_same_features(spark):
    df = frame(spark, 300)
    names = ["event_id", *X.feature_names(True)]
    plain = collect(X.add_features(df).select(*names))
    cut = collect(X.add_features(df, target_rows=40).select(*names))
    for a, b in zip(plain, cut):
        for c in names:
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or math.isclose(a[c], b[c], abs_tol=1e-9)), c


def test_alignment_and_sets(spark):
    df = frame(spark, 2)
    out = X.align(df, ["LPS", "TP2", "nothing"]).first()
    assert (out["LPS"], out["nothing"]) == (1.0, 0.0)
    assert X.select_set(df, "raw").columns == SENSORS
    with pytest.raises(ValueError):
        X.select_set(df, "v3")
    with pytest.raises(MissingColumns):
        project_contract(df.drop("TP2"), keep=[])


def test_transformer_copies_saves_and_checks_its_input(spark, tmp_path):
    step = SensorFeatures(enableV2=False, windowStd=7)
    copy = step.copy({step.windowStd: 9})
    assert (step.getOrDefault("windowStd"), copy.getOrDefault("windowStd")) == (7, 9)
    step.write().save(str(tmp_path / "step"))
    again = SensorFeatures.load(str(tmp_path / "step"))
    assert again.spec() == step.spec()
    assert "TP2_std_7" in again.transform(frame(spark, 10)).columns
    with pytest.raises(TypeError):
        step.transform([1, 2])


def test_validation_reasons(spark):
    df = frame(spark, 3, H1=lambda i: None if i == 1 else 1).withColumn("COMP", F.lit(1.5))
    out = collect(X.validate_readings(df))
    assert out[0]["reasons"] == ["COMP outside 0..1"] and not out[0]["is_valid"]
    assert out[1]["reasons"] == ["missing H1", "COMP outside 0..1"]


def test_repeats_are_judged_against_the_row_before_only(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "a", 1), (5, "b", 1)], "event_id int, k string, t int")
    out = X.drop_consecutive_repeats(df, "k", "t")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 3, 4, 5]
