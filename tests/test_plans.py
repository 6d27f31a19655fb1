"""Physical plans of the main operators: what is shuffled, pushed down and limited early."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from faultlens.operators import features as X
from faultlens.operators.asof import asof_join
from faultlens.operators.history import last_n, newest_page
from faultlens.plans.series import cell_rows, lay_out
from faultlens.queries import REGISTRY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


@pytest.fixture(scope="module")
def series(events):
    return events.select("event_id", "ts", "user_id", F.col("value").alias("TP2"), F.col("value").alias("TP3"), "props")


def test_all_features_share_one_exchange_and_one_sort(series):
    text = plan(X.add_features(series, "user_id"))
    assert exchanges(text) == ["hashpartitioning"] and len(re.findall(r"\bSort\b", text)) == 1


def test_asof_join_is_one_exchange(series):
    out = asof_join(series.drop("TP3", "props"), series.select("event_id", "ts", "user_id", "TP3"), "user_id", ["TP3"])
    assert exchanges(plan(out)) == ["hashpartitioning"]


def test_last_n_is_limited_before_the_shuffle(series):
    text = plan(last_n(series, 5, "user_id"))
    assert text.index("Partial") > text.index("Exchange") and "WindowGroupLimit" in text


def test_near_pages_are_a_top_n(series):
    assert "TakeOrderedAndProject" in plan(newest_page(series, 2, 20))


def test_a_cut_series_is_not_gathered(series):
    laid = lay_out(series, (), target_rows=50)
    for df in (laid.index().rows, laid.fill(["TP2"]).rows, laid.roll(3, lambda d, w, _: d.withColumn("m", F.avg("TP2").over(w.rowsBetween(-3, 0)))).rows):
        assert "SinglePartition" not in plan(df)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(REGISTRY["parquet_scan_pruned"].run(spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,200000.0)]" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


@pytest.mark.parametrize("total, cells", [(10**6, 4), (10**12, 400_000)])
def test_cells_stay_few_enough_to_broadcast(total, cells):
    assert total / cell_rows(total) <= cells


CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ["interval_label_range_join", "circular_zip_blend", "smote", "effective_risk", "standardize", "window_day_group"])
def test_no_cross_joins(spark, name):
    text = plan(REGISTRY[name].run(spark, SMALL))
    assert not any(c in text for c in CROSS)
