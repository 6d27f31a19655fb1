import math

import pytest
from pyspark.sql import functions as F

from faultlens.functions import scalar as S
from faultlens.operators.fleet import alert_rows


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_risk_bands(spark):
    got = column(spark, [0.0, 0.1, 0.299, 0.3, 0.5, 0.649, 0.65, 0.9, 1.0, None], S.risk_level("p"))
    assert got == ["NORMAL"] * 3 + ["ALERTA"] * 3 + ["CRÍTICO"] * 3 + [None]


def test_sanitizer(spark):
    values = [0.0, 0.5, 1.0, -0.5, -100.0, 1.5, 99.0, math.nan, math.inf, -math.inf, None]
    assert column(spark, values, S.sanitize_probability("p")) == [0, 0.5, 1, 0, 0, 1, 1, None, None, None, None]
    text = spark.createDataFrame([('"0.5"',), ("0.5",), ("x",)], "t string")
    assert [r[0] for r in text.select(S.sanitize_text_probability("t")).collect()] == [None, 0.5, None]


def test_alert_threshold_is_strict(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.5, 0.699, 0.70, 0.71, 0.85, 0.99, 1.0)], "probability double")
    df = df.withColumns({"asset_id": F.lit("a"), "ts": F.lit("2024-01-01").cast("timestamp")})
    assert sorted(r["probability"] for r in alert_rows(df).collect()) == [0.71, 0.85, 0.99, 1.0]


def test_sigmoid_and_softmax_do_not_overflow(spark):
    got = column(spark, [-1e6, 0.0, 1e6], S.sigmoid(F.col("p")))
    assert got == [0.0, 0.5, 1.0]
    assert column(spark, [1e6, -1e6], S.softmax2(F.lit(0.0), "p")) == [1.0, 0.0]
    assert math.isclose(column(spark, [0.0], S.anomaly_score("p", 0.3))[0], 1 / (1 + math.exp(3)))
    with pytest.raises(ValueError):
        S.anomaly_score("p", 0.0)


def test_threshold_resolution(spark):
    df = spark.createDataFrame([("0.7",), ("1",), ("0",), ("x",), (None,), ("nan",)], "t string")
    assert [r[0] for r in df.select(S.resolve_threshold("t")).collect()] == [0.7, 0.5, 0.5, 0.5, 0.5, 0.5]


def test_capacity_is_clamped_and_rounded(spark):
    got = column(spark, [10.1, 99.0, -3.0, None, math.nan], S.capacity_percent("p", 12.0))
    assert got == [84.2, 100.0, 0.0, None, None]
