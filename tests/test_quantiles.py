import numpy as np
from pyspark.sql import functions as F

from faultlens.plans.quantiles import exact_percentiles


def test_narrowing_equals_numpy(events, monkeypatch):
    import faultlens.plans.quantiles as q

    monkeypatch.setattr(q, "ACCURACY", 50)
    monkeypatch.setattr(q, "SORT_ROWS", 20)
    df = events.select(
        "value",
        F.when(F.col("event_id") % 2 == 0, F.lit(1.5)).otherwise(F.col("value")).alias("tied"),
        F.lit(None).cast("double").alias("empty"),
    )
    got = exact_percentiles(df, ["value", "tied", "empty"], [0, 0.25, 0.5, 0.99, 1], target_rows=10)
    data = df.toPandas()
    for c in ("value", "tied"):
        np.testing.assert_allclose(got[c], np.percentile(data[c], [0, 25, 50, 99, 100]), rtol=0, atol=1e-12)
    assert got["empty"] == [None] * 5


def test_narrowing_ends_on_infinite_and_spread_values(spark, monkeypatch):
    import faultlens.plans.quantiles as q

    monkeypatch.setattr(q, "ACCURACY", 40)
    monkeypatch.setattr(q, "SORT_ROWS", 20)
    values = [float("inf")] * 40 + [float("-inf")] * 3 + [0.0] * 300 + [10.0**k for k in range(-300, 300, 2)] + [-1e308, 1e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_percentiles(df, ["x"], [0.5, 0.9, 0.75], target_rows=10)["x"]
    np.testing.assert_allclose(got, np.percentile(values, [50, 90, 75]), rtol=1e-12)
    ranks = exact_percentiles(df, ["x"], [0.0, 1.0], target_rows=10)["x"]
    assert ranks == [float("-inf"), float("inf")]
