"""Micro-batches must give the batch result, with cold starts, late rows and replays."""

import math

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from faultlens.operators.features import add_features, feature_names
from faultlens.queries.registry import sensors
from faultlens.schema import SENSORS
from faultlens.sources.sinks import write_batch
from faultlens.streaming.live import LivePath, active_model_scorer
from faultlens.streaming.readings import UpsertByBatch, daily_alerts_so_far, file_stream, run_once
from faultlens.streaming.stateful import with_buffer

COLUMNS = ["asset_id", "ts", "event_id", *SENSORS]


@pytest.fixture(scope="module")
def rows(spark):
    """A few assets, one of them with half of the readings."""
    hot = F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("asset_id") % 5 + 1)
    return sensors(spark, SMALL).withColumn("asset_id", hot.cast("bigint")).select(*COLUMNS).cache()


@pytest.mark.parametrize("target", [10**6, 40])
def test_stream_in_five_files_equals_batch(spark, rows, tmp_path, target):
    source, names = str(tmp_path / "in"), feature_names(True)
    line = LivePath(str(tmp_path / "live"), target_rows=target)
    bounds = rows.approxQuantile("event_id", [0.2, 0.4, 0.6, 0.8], 0)
    edges = [-1, *bounds, 10**9]
    for lo, hi in zip(edges, edges[1:]):
        rows.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(source)
        run_once(file_stream(spark, source, rows.schema), str(tmp_path / "cp"), each=line)
    got = line.results(spark)
    assert got.count() == rows.count()
    warm = {r["event_id"]: r for r in got.where("is_warm").select("event_id", *names).collect()}
    batch = add_features(rows, "asset_id", gaps=False)
    w = batch.select("asset_id", "event_id", *names).collect()
    seen = {}
    checked = 0
    for r in sorted(w, key=lambda r: r["event_id"]):
        seen[r["asset_id"]] = seen.get(r["asset_id"], 0) + 1
        if seen[r["asset_id"]] < 16:
            assert r["event_id"] not in warm
            continue
        checked += 1
        for c in names:
            a, b = r[c], warm[r["event_id"]][c]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), c
    assert checked == len(warm) > 500


def batch_of(spark, items):
    values = [(a, i, float(v)) for a, i, v in items]
    df = spark.createDataFrame(values, "asset_id bigint, event_id bigint, TP2 double")
    start = F.lit("2024-01-01").cast("timestamp")
    df = df.withColumn("ts", start + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)")))
    return df.withColumns({c: F.lit(0.5) for c in SENSORS if c != "TP2"})


def score(df):
    return df.withColumn("probability", F.least(F.lit(1.0), F.col("TP2") / 100))


def test_cold_start_quarantine_late_rows_and_alerts(spark, tmp_path):
    line = LivePath(str(tmp_path), score, keep_features=True)
    line(batch_of(spark, [(1, i, 10) for i in range(10, 20)]).unionByName(
        batch_of(spark, [(2, 5, 90)])).unionByName(batch_of(spark, [(3, 1, 1)]).withColumn("COMP", F.lit(7.0))), 0)
    assert line.results(spark, "late").count() == 0
    line(batch_of(spark, [(1, 15, 99), (1, 20, 71), (1, 21, 70), (4, 0, 1)]), 1)
    got = {(r["asset_id"], r["event_id"]): r for r in line.results(spark).collect()}
    assert len(got) == 14 and (3, 1) not in got and (1, 15) in got and got[1, 15]["TP2"] == 10
    cold = got[1, 12]
    assert not cold["is_warm"] and cold["TP2_ma_15"] == 10 and cold["TP2_lag_15"] == 0 and cold["TP2_TP3_diff"] == 9.5
    assert [r["reasons"] for r in line.results(spark, "quarantine").collect()] == [["COMP outside 0..1"]]
    assert [(r["asset_id"], r["TP2"]) for r in line.results(spark, "late").collect()] == [(1, 99.0)]
    alerts = sorted(r["probability"] for r in line.results(spark, "alerts").collect())
    assert alerts == [0.71, 0.9]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    line = LivePath(str(tmp_path), score)
    for b in range(4):
        for _ in range(2):
            line(batch_of(spark, [(1, i, i) for i in range(b * 10, b * 10 + 10)]), b)
    got = sorted((r["event_id"], r["is_warm"]) for r in line.results(spark).collect())
    assert got == [(i, i >= 15) for i in range(40)]


def test_a_failed_history_write_is_retried_alone(spark, tmp_path):
    """The history write fails once: alerts and quarantine go out all the same, and once only; the replay ends the batch."""
    source, calls = str(tmp_path / "in"), {"predictions": 0, "alerts": 0}
    rows = batch_of(spark, [(1, i, 60 + i) for i in range(20)])
    rows.withColumn("COMP", F.when(F.col("event_id") == 5, 9.0).otherwise(F.col("COMP"))).coalesce(1).write.parquet(source)

    def history(df, batch_id):
        calls["predictions"] += 1
        if calls["predictions"] == 1:
            raise OSError("the history is not reachable")
        write_batch(df, line.path("predictions"), batch_id, "ts")

    def alerts(df, batch_id):
        calls["alerts"] += 1
        write_batch(df, line.path("alerts"), batch_id)

    line = LivePath(str(tmp_path / "live"), score, sinks={"predictions": history, "alerts": alerts})
    stream = file_stream(spark, source, rows.schema)
    with pytest.raises(StreamingQueryException):
        run_once(stream, str(tmp_path / "cp"), each=line)
    assert line.results(spark, "alerts").count() == 9 and line.results(spark, "quarantine").count() == 1
    run_once(stream, str(tmp_path / "cp"), each=line)
    assert calls == {"predictions": 2, "alerts": 1}
    assert sorted(r["event_id"] for r in line.results(spark).collect()) == [i for i in range(20) if i != 5]
    assert line.results(spark, "alerts").count() == 9


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    """Cost follows the arrivals: buffers of assets without a reading stay where they are, and old ones go."""
    line = LivePath(str(tmp_path), buckets=16)
    line(batch_of(spark, [(a, a, 1) for a in range(40)]), 0)
    for b in range(1, 5):
        line(batch_of(spark, [(7, 100 + b, b)]), b)
    state = tmp_path / "state"
    folders = {b: sorted(x.name for x in (state / f"batch={b}").glob("bucket=*")) for b in range(5)}
    assert len(folders[0]) > 8 and all(len(folders[b]) <= 1 for b in range(1, 5))
    assert not folders[1] and not folders[2] and folders[3] == folders[4] and folders[4][0] not in folders[0]
    kept = spark.read.parquet(*[str(p) for p in state.glob("batch=*/bucket=*")])
    assert kept.select("asset_id").distinct().count() == 40
    line(batch_of(spark, [(7, 200, 5), (8, 201, 5)]), 5)
    got = line.results(spark)
    assert got.count() == 46


def test_open_days_are_counted_as_they_stand(spark, tmp_path):
    source = str(tmp_path / "in")
    days = UpsertByBatch(str(tmp_path / "out"), ["day"])
    seen = []
    for part in (["2024-01-01 10:00", "2024-01-01 11:00"], ["2024-01-01 12:00", "2024-01-02 00:01"], ["2024-01-02 09:00"]):
        spark.createDataFrame([(t, "ALERTA") for t in part], "t string, severity string").select(F.col("t").cast("timestamp").alias("ts"), "severity").coalesce(1).write.mode("append").parquet(source)
        counts = daily_alerts_so_far(file_stream(spark, source, T.StructType.fromDDL("ts timestamp, severity string")))
        run_once(counts, str(tmp_path / "cp"), each=days, mode="update")
        seen.append(sorted((r["day"].day, r["critical"], r["alert"]) for r in days.rows(spark, counts.schema).collect()))
    assert seen == [[(1, 0, 2)], [(1, 0, 3), (2, 0, 1)], [(1, 0, 3), (2, 0, 2)]]


def test_the_active_model_can_change_between_batches(spark, tmp_path):
    table = str(tmp_path / "active")
    models = {"low": lambda df: df.withColumn("probability", F.lit(0.1)), "high": lambda df: df.withColumn("probability", F.lit(0.9))}
    line = LivePath(str(tmp_path / "live"), active_model_scorer(spark, table, models))
    for b, name in enumerate(["low", "high"]):
        spark.createDataFrame([(name, b)], "model_name string, since int").write.mode("append").parquet(table)
        line(batch_of(spark, [(1, b, 1)]), b)
    got = {r["event_id"]: (r["probability"], r["predicted_class"]) for r in line.results(spark).collect()}
    assert got == {0: (0.1, 0), 1: (0.9, 1)}


def test_per_key_buffer_in_the_state_store(spark, tmp_path):
    source = str(tmp_path / "in")
    for lo in (0, 10):
        batch_of(spark, [(k, i, i) for k in (1, 2) for i in range(lo, lo + 10)]).select(
            "asset_id", "event_id", "TP2"
        ).coalesce(1).write.mode("append").parquet(source)

    def step(history: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
        known = len(history)
        return pd.DataFrame({"event_id": arrived["event_id"], "known": [known] * len(arrived)})

    schema = T.StructType(
        [T.StructField("asset_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("known", T.LongType())]
    )
    stream = spark.readStream.schema("asset_id bigint, event_id bigint, TP2 double").option("maxFilesPerTrigger", 1).parquet(source)
    out = with_buffer(stream, "asset_id", "event_id", 8, step, schema)
    run_once(out, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = [tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == 40 and {n for *_, n in got} == {0, 8}


def test_each_arrival_is_one_batch_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """An arrival is written by as many tasks as read the table, and taken in as one micro-batch; none is left over."""
    from faultlens.queries import streams

    source, seen, path = tmp_path / "t", [], str(tmp_path / "cp")
    spark.range(0, 1000, 1, 4).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    ).write.parquet(str(source / "events.parquet"))
    monkeypatch.setattr(streams, "scratch", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(streams, "sensors", lambda s, sf: streams.to_readings(s.read.parquet(f"{sf}/events.parquet")).repartition(4))

    def each(batch, batch_id):
        ids = sorted(r[0] for r in batch.select("event_id").collect())
        seen.append((batch_id, ids[0], len(ids)))

    streams.batched(spark, str(source), streams.on_time, lambda rows: run_once(rows, path, each=each))
    assert seen == [(i, 200 * i, 200) for i in range(5)]
    assert len(list((tmp_path / "feed").glob("*.parquet"))) == 20


def test_only_what_features_need_is_carried_from_the_buffers(spark, rows, tmp_path, monkeypatch):
    line, carried, features = LivePath(str(tmp_path / "live"), buckets=2), [], LivePath._features
    monkeypatch.setattr(LivePath, "_features", lambda self, df: carried.append(df.where("NOT _fresh").groupBy("asset_id").count().agg(F.max("count")).first()[0]) or features(self, df))
    one = rows.where("asset_id = 0")
    line(one.where("event_id < 400"), 0)
    line(one.where("event_id >= 400"), 1)
    assert carried == [None, 15]
    assert line.results(spark).where("NOT is_warm").count() == 15
    state = tmp_path / "live" / "state" / "batch=1"
    assert spark.read.parquet(str(state)).count() == 30 and len(list(state.glob("bucket=*/*.parquet"))) == 1
