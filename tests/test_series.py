"""Cut series must give what one window over the whole series gives."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conftest import rows
from faultlens.plans.series import lay_out

K = 15


@pytest.fixture(scope="module")
def skewed(events):
    """One asset, of no name, with half of all rows, bursts at one instant, and long null runs."""
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 2 == 1, F.col("user_id") % 7 + 1).alias("asset_id"),
        F.when(F.col("event_id").between(200, 500), F.lit("2024-01-10").cast("timestamp_ntz"))
        .otherwise(F.col("ts"))
        .alias("ts"),
        F.when((F.col("event_id") % 5 == 1) | F.col("event_id").between(600, 800), None)
        .otherwise(F.col("value"))
        .alias("x"),
    )


def add_rolling(df, w, long):
    return df.withColumn("ma", F.round(F.avg("x").over(w.rowsBetween(1 - K, 0)), 9)).withColumn(
        "back", F.lag("x", K).over(w)
    )


@pytest.mark.parametrize("target", [20, 64])
@pytest.mark.parametrize("key", ["asset_id", ()])
def test_cut_series_equal_plain_windows(skewed, key, target):
    plain, cut = lay_out(skewed, key), lay_out(skewed, key, target_rows=target)
    assert plain.chunks is None and cut.chunks is not None
    assert cut.chunks.agg(F.max("_rows")).first()[0] <= 4 * target
    assert rows(plain.roll(K, add_rolling).rows, "event_id", "ma", "back") == rows(
        cut.roll(K, add_rolling).rows, "event_id", "ma", "back"
    )
    assert rows(plain.index().rows, "event_id", "rn") == rows(cut.index().rows, "event_id", "rn")
    for backward in (False, True):
        assert rows(plain.fill(["x"], backward).rows, "event_id", "x") == rows(
            cut.fill(["x"], backward).rows, "event_id", "x"
        )


@pytest.mark.parametrize("how, exclusive", [("sum", False), ("max", True), ("min", False)])
def test_running_aggregates(skewed, how, exclusive):
    plain, cut = (lay_out(skewed, "asset_id", target_rows=n) for n in (10**6, 40))
    got = [
        rows(s.running("x", how, "v", exclusive).rows.withColumn("v", F.round("v", 6)), "event_id", "v")
        for s in (plain, cut)
    ]
    assert got[0] == got[1]


def test_steps_chain_on_one_layout(skewed):
    def chain(s):
        out = s.fill(["x"], True).roll(K, add_rolling).index().rows
        return rows(out, "event_id", "x", "ma", "back", "rn")

    assert chain(lay_out(skewed, "asset_id")) == chain(lay_out(skewed, "asset_id", target_rows=40))


def test_index_is_dense(skewed):
    out = lay_out(skewed, target_rows=50).index("pos", start=0).rows
    got = [r[0] for r in out.orderBy("pos").select("pos").collect()]
    assert got == list(range(skewed.count()))


def test_cells_are_cut_on_the_tiebreak_when_time_stands_still(skewed):
    still = skewed.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    laid = lay_out(still, (), target_rows=30)
    assert laid.chunks.agg(F.max("_rows")).first()[0] <= 120
    w = W.partitionBy(F.lit(1)).orderBy("event_id")
    want = still.withColumn("rn", F.row_number().over(w) - 1)
    assert rows(laid.index(start=0).rows, "event_id", "rn") == rows(want, "event_id", "rn")


def test_ids_may_span_the_whole_bigint_range(spark):
    ids = spark.range(400).select((F.xxhash64("id")).alias("event_id"), F.lit(1).alias("ts"))
    laid = lay_out(ids, (), target_rows=30)
    assert laid.chunks.agg(F.max("_rows")).first()[0] <= 120
    w = W.partitionBy(F.lit(1)).orderBy("event_id")
    assert rows(laid.index().rows, "event_id", "rn") == rows(ids.withColumn("rn", F.row_number().over(w)), "event_id", "rn")
