from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultlens.operators import history as H
from faultlens.operators.asof import asof_join
from faultlens.plans.positions import SortKey, rows_at, rows_before
from faultlens.sources import sinks as K


@pytest.fixture(scope="module")
def seven(spark):
    return spark.range(7).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-06-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
    )


@pytest.mark.parametrize("deep", [100_000, 0])
def test_pages_are_disjoint_newest_first_and_cover_the_table(seven, deep):
    pages = [[r["event_id"] for r in H.newest_page(seven, p, 3, deep=deep).collect()] for p in (1, 2, 3, 4)]
    assert pages == [[6, 5, 4], [3, 2, 1], [0], []]
    s = H.page_summary(seven, 4, 3).first()
    assert (s["total"], s["pages"]) == (7, 3)
    assert H.page_summary(seven.limit(0), 1, 3).first()["pages"] == 0


@pytest.mark.parametrize("page, size", [(0, 10), (1, 0), (1, 101)])
def test_page_bounds(seven, page, size):
    with pytest.raises(ValueError):
        H.newest_page(seven, page, size)


def test_head_by_position(seven):
    for deep in (0, 100):
        assert sorted(r["event_id"] for r in H.head_rows(seven, 3, deep=deep).collect()) == [0, 1, 2]


def test_log_page_is_clamped(spark, seven):
    log = seven.withColumn("severity", F.when(F.col("event_id") == 3, "CRÍTICO").when(F.col("event_id") == 5, "ALERTA").otherwise("NORMAL"))
    out = H.event_page(log, "severity", True, page=9, size=5).collect()
    assert [r["event_id"] for r in out] == [4, 6] and out[0]["shown_from"] == 6 and out[0]["shown_to"] == 7
    first = H.event_page(log, "severity", True, page=1, size=2).collect()
    assert [r["event_id"] for r in first] == [3, 5]
    assert H.event_page(log.limit(0), "timestamp").collect() == []


@pytest.mark.parametrize("column, descending", [("severity", True), ("type", False)])
def test_log_pages_from_start_middle_and_end_agree(spark, column, descending):
    log = spark.range(90).select(
        F.col("id").alias("event_id"),
        F.element_at(F.array(F.lit("NORMAL"), F.lit("CRÍTICO"), F.lit("ALERTA")), (F.col("id") % 3 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("type"),
    )
    for page in (1, 4, 9):
        pages = [
            sorted(r["event_id"] for r in H.event_page(log, column, descending, page, deep=deep).collect())
            for deep in (1000, 25, 0)
        ]
        assert pages[0] == pages[1] == pages[2] and len(pages[0]) == 10


def test_spine_has_every_day(spark):
    log = spark.createDataFrame(
        [("2024-01-03 23:59:59", "CRÍTICO"), ("2024-01-03 00:00:00", "ALERTA"), ("2024-01-05 10:00:00", "NORMAL")],
        "t string, severity string",
    ).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = [(r["label"], r["critical"], r["alert"]) for r in H.daily_alert_counts(log, "2024-01-05", 4).orderBy("day").collect()]
    assert got == [("02/01", 0, 0), ("03/01", 1, 1), ("04/01", 0, 0), ("05/01", 0, 0)]
    peak = H.alert_peak(H.daily_alert_counts(log, "2024-01-05", 4)).first()
    assert (peak["total_alerts"], peak["peak"], str(peak["peak_day"])) == (2, 2, "2024-01-03")


def test_asof_at_equal_times_and_cut_series(spark):
    t = lambda i: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=i)
    left = spark.range(300).select(F.col("id").alias("event_id"), F.lit(1).alias("k"), t(F.col("id").cast("decimal(18,6)")).alias("ts"))
    right = left.where("event_id % 50 = 25").withColumn("v", F.col("event_id"))
    for target in (10**6, 30):
        for equal, shift in ((True, 0), (False, 1)):
            out = asof_join(left, right, "k", ["v"], allow_equal=equal, target_rows=target).collect()
            assert len(out) == 300
            for r in out:
                i = r["event_id"] - shift
                assert r["v"] == (None if i < 25 else (i - 25) // 50 * 50 + 25)


def test_export_has_bom_header_and_any_rows(spark, seven, tmp_path):
    log = seven.limit(2).withColumns({c: F.lit(c) for c in ("equipment", "type", "severity", "duration")})
    K.export_event_log(log.coalesce(1), str(tmp_path / "x"))
    text = next((tmp_path / "x").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿ID;Timestamp;Equipamento;Tipo;Severidade;Duração") and len(text.splitlines()) == 3


def test_a_replayed_batch_replaces_itself(spark, seven, tmp_path):
    path = str(tmp_path / "p")
    for n in (7, 4):
        K.write_batch(seven.limit(n), path, 0, "ts")
    K.write_batch(seven.limit(2), path, 1, "ts")
    assert K.read_batches(spark, path).count() == 6


@pytest.mark.parametrize("target", [None, 3])
def test_asof_without_key_matches_nothing(spark, target):
    schema = "event_id int, k int, ts timestamp_ntz, v int"
    at = lambda *r: [(i, k, datetime(2024, 1, 1, 0, m), v) for i, k, m, v in r]
    left = spark.createDataFrame(at((1, None, 5, 0), (2, 1, 5, 0), (3, None, 9, 0), (4, 2, 1, 0)), schema).drop("v")
    right = spark.createDataFrame(at((1, None, 1, 7), (2, 1, 1, 8), (3, None, 2, 9)), schema)
    out = asof_join(left, right, "k", ["v"], target_rows=target)
    assert sorted((r["event_id"], r["v"]) for r in out.collect()) == [(1, None), (2, 8), (3, None), (4, None)]


def test_middle_pages_sort_only_their_ranges(spark):
    """Neither sort nor row numbers over the whole table: what is sorted is the few rows left in the ranges."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp_seconds(id div 7)").cast("timestamp_ntz").alias("ts"), F.expr("if(id % 11 = 0, null, id % 5)").alias("x"))
    got = H.newest_page(df, page=1001, size=100, deep=1000)
    assert [r["event_id"] for r in got.collect()] == list(range(n - 100_001, n - 100_101, -1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan and "TakeOrderedAndProject" in plan
    keys = [SortKey(F.col("x"), True), SortKey(F.col("event_id"))]
    want = [r["event_id"] for r in df.orderBy(F.desc("x"), "event_id").collect()]
    for start in (0, 77_777, n - 20_000, n - 3):
        assert [r["event_id"] for r in rows_at(df, keys, start, 5, 10).collect()] == want[start : start + 5]
    assert rows_at(df, keys, n, 5, 10).count() == 0
    assert sorted(r["event_id"] for r in rows_before(df, keys, 190_000, 10).collect()) == sorted(want[:190_000])
    assert rows_before(df.limit(5), keys, 9, 1).count() == 5


@pytest.mark.parametrize("values", [["b", "a", None, "é", "", "a", "B"], [1.5, None, float("nan"), float("inf"), -0.0, 0.0, float("-inf")]])
def test_slices_of_any_key(spark, values):
    """NULL, NaN, infinities and texts come as Spark sorts them, in both directions."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"event_id long, x {'string' if isinstance(values[0], str) else 'double'}")
    for down in (False, True):
        keys = [SortKey(F.col("x"), down), SortKey(F.col("event_id"))]
        want = [r["event_id"] for r in df.orderBy(*[k.order for k in keys]).collect()]
        assert [rows_at(df, keys, i, 1, 0).first()["event_id"] for i in range(len(values))] == want
