import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators.labels import FAILURES, healthy_faulty_split, label_by_table, label_intervals
from faultlens.schema import RAW_SCHEMA, SENSORS, UNMODELLED, MissingColumns
from faultlens.sources import ingest as I
from faultlens.sources.feed import classify, feed_totals


def stamps(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select("t", F.col("t").cast("timestamp_ntz").alias("ts"))


EDGES = {
    "2020-04-17 23:59:59": 0,
    "2020-04-18 00:00:00": 1,
    "2020-04-18 23:59:00": 1,
    "2020-04-18 23:59:01": 0,
    "2020-05-30 06:00:00": 1,
    "2020-06-06 12:00:00": 1,
    "2020-07-15 19:00:00": 1,
    "2020-07-15 19:00:01": 0,
}


@pytest.mark.parametrize("way", ["literals", "table", "crowded table"])
def test_interval_ends_are_inside_and_overlaps_do_not_repeat_rows(spark, way):
    df = stamps(spark, EDGES)
    extra = FAILURES + (("2020-04-18 00:00:00", "2020-04-18 12:00:00"), FAILURES[0])
    if way == "literals":
        out = label_intervals(df, extra, kind="int")
    else:
        table = spark.createDataFrame(list(extra), "start string, end string")
        table = table.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")])
        limits = {"per_hour": 0, "target_rows": 3} if way == "crowded table" else {}
        out = label_by_table(df, table, kind="int", **limits)
    assert {r["t"]: r["anomaly"] for r in out.collect()} == EDGES
    assert out.count() == len(EDGES) and "anomaly" not in df.columns


def test_split_falls_back(spark):
    df = stamps(spark, EDGES)
    healthy, faulty = healthy_faulty_split(df)
    assert (healthy.count(), faulty.count()) == (3, 5)
    healthy, faulty = healthy_faulty_split(df, (("1990-01-01", "1990-01-02"),))
    assert healthy.count() == faulty.count() == len(EDGES)
    marked = spark.createDataFrame([(1,), (0,), (0,)], "anomaly int")
    assert [d.count() for d in healthy_faulty_split(marked)] == [2, 1]


@pytest.fixture
def csv(spark, tmp_path):
    """Five rows, newest first, with a leading index column as exported files have."""
    names = SENSORS + UNMODELLED
    lines = [",".join(["", *names[:3], "timestamp", *names[3:]])]
    for i in reversed(range(5)):
        lines.append(",".join([str(i), *["0.1"] * 3, f"2020-04-18 00:00:0{i}", *["0.0"] * (len(names) - 3)]))
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines))
    return str(path)


def test_ingestion_is_sorted_narrow_labelled_and_runs_once(spark, csv, tmp_path):
    out = str(tmp_path / "out")
    assert not I.is_ingested(spark, out)
    assert I.ingest(spark, csv, out) and not I.ingest(spark, csv, out)
    back = spark.read.parquet(out)
    assert set(RAW_SCHEMA.fieldNames()) | {"anomaly", "day"} == set(back.columns)
    assert back.schema["TP2"].dataType == T.FloatType() and back.schema["anomaly"].dataType == T.ByteType()
    assert back.count() == 5 and back.agg(F.sum(F.col("anomaly").cast("int"))).first()[0] == 5
    for f in back.inputFiles():
        seen = [r[0] for r in spark.read.parquet(f).select("timestamp").collect()]
        assert seen == sorted(seen)
    assert set(I.scan(spark, out).columns) == {"timestamp", "anomaly", *SENSORS}


def test_an_output_without_label_is_written_again(spark, csv, tmp_path):
    out = str(tmp_path / "old")
    spark.range(3).write.parquet(out)
    assert not I.is_ingested(spark, out)
    assert I.ingest(spark, csv, out)


def test_missing_column_raises(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("timestamp,TP2\n2020-01-01 00:00:00,1")
    with pytest.raises(MissingColumns, match="TP3"):
        I.read_raw_csv(spark, str(path))


def test_feed_lines(spark):
    need = ["a", "b"]
    texts = ['data: {"a":1,"b":2}', 'data: {"a":1}', "data: {oops", "event: x", "", 'data: {"a":1,"b":null,"c":3}']
    df = spark.createDataFrame([(1, t) for t in texts], "client_id int, line string")
    got = [r["status"] for r in classify(df, need).collect()]
    assert got == ["valid", "incomplete", "malformed", "valid"]


def test_feed_totals_ignore_failed_clients(spark):
    q = spark.createDataFrame(
        [(1, 10, 1, 0, None), (2, 30, 0, 1, None), (3, 99, 9, 9, "HTTP 500")],
        "client_id int, events bigint, malformed bigint, incomplete bigint, error string",
    )
    r = feed_totals(q, 25, "error", min_clients=2).first()
    assert (r["ok_clients"], r["failed_clients"], r["total_events"], r["avg_events"]) == (2, 1, 40, 20.0)
    assert r["enough_clients"] and r["enough_events"]
    assert not feed_totals(q.limit(0), 25, "error").first()["enough_events"]
