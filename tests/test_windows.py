import pytest
from pyspark.sql import functions as F

from faultlens.operators import windows as V
from faultlens.operators.sampling import leaked_rows


@pytest.fixture(scope="module")
def series(spark):
    ts = F.lit("2024-01-01 23:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))
    return spark.range(500).select(
        F.col("id").alias("event_id"),
        ts.alias("ts"),
        F.col("id").cast("double").alias("a"),
        (-F.col("id")).cast("double").alias("b"),
        (F.col("id") == 105).cast("int").alias("y"),
    )


@pytest.mark.parametrize("length, stride", [(60, 10), (20, 30), (7, 3), (60, 60)])
def test_windows_equal_slices(series, length, stride):
    out = V.sliding_windows(series, ["a", "b"], length=length, stride=stride, label="y", target_rows=50)
    got = {r["wid"]: r for r in out.collect()}
    assert sorted(got) == list(range(V.window_count(500, length, stride)))
    for wid, r in got.items():
        lo = wid * stride
        assert r["x"] == [[float(i), float(-i)] for i in range(lo, lo + length)]
        assert r["y"] == int(lo <= 105 < lo + length)


def test_too_short_a_series_is_an_error():
    with pytest.raises(ValueError):
        V.window_count(59)


def test_day_groups_can_leave_out_windows_that_span_two_days(series):
    w = V.sliding_windows(series, ["a"])
    assert V.windows_by_day(w, drop_cross_day=False).count() == V.window_count(500)
    kept = V.windows_by_day(w)
    assert kept.count() < V.window_count(500)
    assert kept.where(F.to_date("first_ts") != F.to_date("last_ts")).isEmpty()


def test_pad_patch_and_flatten(spark, series):
    w = V.sliding_windows(series, ["a", "b"]).where("wid = 0")
    r = w.select(
        V.patches("x", 2).alias("p"),
        V.unflatten_window(V.flatten_window("x"), 2).alias("back"),
        "x",
        V.left_pad(F.slice("x", 1, 3), 5).alias("short"),
        V.left_pad("x", 5).alias("long"),
    ).first()
    assert len(r["p"]) == 9 and r["p"][1] == [float(i) for i in range(6, 18)] + [float(-i) for i in range(6, 18)]
    assert r["back"] == r["x"]
    assert r["short"] == [r["x"][0]] * 3 + r["x"][1:3] and r["long"] == r["x"][-5:]


def test_scaler_matches_numpy_and_keeps_flat_channels(spark, series):
    w = V.sliding_windows(series.withColumn("b", F.lit(3.0)), ["a", "b"])
    import numpy as np

    x = np.array([r["x"] for r in w.collect()]).reshape(-1, 2)
    mean, std = V.window_scaler(w, 2)
    np.testing.assert_allclose(mean, x.mean(0))
    np.testing.assert_allclose(std, x.std(0), atol=1e-12)
    z = w.where("wid = 0").select(V.standardize_window("x", mean, std).alias("z")).first()["z"]
    assert z[5][1] == 0.0


def test_blend_ends_at_the_faulty_row(spark, series):
    healthy = series.select("event_id", "ts", F.lit(10.0).alias("a"))
    faulty = series.limit(7).select("event_id", "ts", F.lit(20.0).alias("a"))
    out = {r["step"]: r["a"] for r in V.circular_blend(healthy, faulty, ["a"]).collect()}
    assert out[1] == pytest.approx(10.0, rel=0.05)
    assert out[300] == out[400] == 20.0
    assert 10 < out[50] < out[250] < 20


def test_ramp_restarts_with_the_mode(spark, series):
    moded = series.withColumn("mode", (F.col("event_id") >= 350).cast("int"))
    got = {r["event_id"]: r["drift"] for r in V.drift_ramp(moded, "mode", target_rows=60).collect()}
    assert got[0] == 1 / 300 and got[149] == 0.5 and got[349] == 1.0 and got[350] == 1 / 300


def test_leak_check_finds_shared_content(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id int, v double")
    b = spark.createDataFrame([(4, 2.0), (5, 3.0), (6, None)], "id int, v double")
    assert sorted(r["id"] for r in leaked_rows(a, b, ["v"]).collect()) == [4, 6]


@pytest.mark.parametrize("n_faulty", [1, 3, 40, 250])
def test_blend_deals_few_faulty_rows_to_blocks(spark, n_faulty, monkeypatch):
    """Few or many faulty rows: each step meets row i mod n, and no task gets far more rows than the median."""
    monkeypatch.setattr(V, "ZIP_BLOCK", 16)
    monkeypatch.setattr(V, "COPIES_AT_ONCE", 5)
    rows = lambda n, k: spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") * k).cast("double").alias("a"))
    out = V.circular_blend(rows(200, 0), rows(n_faulty, 1), ["a"], steps=1)
    assert sorted((r["step"], r["a"]) for r in out.collect()) == [(i + 1, float(i % n_faulty)) for i in range(200)]


def test_unflatten_evaluates_its_input_once(spark):
    """What is cut into rows is not made again for each row, and NULL stays NULL."""
    from faultlens.operators.windows import flatten_window, unflatten_window

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<array<double>>")
    def made(i):
        calls.add(1)
        return None if i else [[float(t), float(-t)] for t in range(60)]

    df = spark.range(2).select(F.transform(F.array("id"), lambda i: i).alias("i"), made("id").alias("x"))
    got = [r[0] for r in df.select(unflatten_window(flatten_window("x"), 2)).collect()]
    assert [[float(t), float(-t)] for t in range(60)] in got and None in got and len(got) == 2
    plan = df.select(flatten_window(unflatten_window(flatten_window("x"), 2)).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array(flatten(" in plan
