from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import features as X
from faultlens.operators.scoring import SensorFeatures
from faultlens.plans.series import lay_out
from faultlens.queries.registry import R_SQL, S_SQL, query, r6, readings, scratch, sensors
from faultlens.schema import ANALOGUE, SENSORS

W_SQL = "OVER (PARTITION BY asset_id ORDER BY ts, event_id{frame})"


def over(frame: str = "") -> str:
    return W_SQL.format(frame=f" ROWS {frame}" if frame else "")


def roll(spark, sf, build, lookback=15):
    rows = readings(spark, sf).select("event_id", "ts", "asset_id", "value")
    return lay_out(rows, "asset_id").roll(lookback, build).rows


GAPS_SQL = R_SQL + """,
g AS (SELECT event_id, ts, asset_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, k FROM r)"""


def with_gaps(spark, sf):
    return readings(spark, sf).select(
        "event_id", "ts", "asset_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "k"
    )


IMPUTE_SQL = """SELECT event_id, coalesce(
    last_value(value IGNORE NULLS) OVER ({part}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
    first_value(value IGNORE NULLS) OVER ({part}ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM g"""


@query("impute_ffill_bfill", f"WITH {GAPS_SQL} " + IMPUTE_SQL.format(part="PARTITION BY asset_id "))
def impute_ffill_bfill(spark, sf):
    return X.impute(with_gaps(spark, sf), "asset_id", columns=["value"]).select("event_id", "value")


@query("chunked_fill", f"WITH {GAPS_SQL} " + IMPUTE_SQL.format(part=""))
def chunked_fill(spark, sf):
    """The whole table as one series, cut into cells with carried values."""
    return X.impute(with_gaps(spark, sf), (), columns=["value"], target_rows=2000).select("event_id", "value")


@query(
    "pressure_delta",
    f"WITH {R_SQL} SELECT event_id, round(coalesce(value - lag(value) {over()}, 0), 6) + 0.0 AS delta FROM r",
)
def pressure_delta(spark, sf):
    return roll(spark, sf, lambda df, w, _: df.withColumn("delta", r6(X.delta("value", w))), 1).select(
        "event_id", "delta"
    )


@query(
    "rolling_std",
    f"WITH {R_SQL} SELECT event_id, round(coalesce(stddev_samp(value) {over('4 PRECEDING')}, 0), 6) AS std_5 FROM r",
)
def rolling_std(spark, sf):
    return roll(spark, sf, lambda df, w, _: df.withColumn("std_5", r6(X.rolling_std("value", w, 5))), 4).select(
        "event_id", "std_5"
    )


@query(
    "moving_averages",
    f"""WITH {R_SQL} SELECT event_id, round(avg(value) {over('4 PRECEDING')}, 6) AS ma_5,
    round(avg(value) {over('14 PRECEDING')}, 6) AS ma_15 FROM r""",
)
def moving_averages(spark, sf):
    def build(df, w, _):
        return df.withColumns({f"ma_{n}": r6(X.rolling_mean("value", w, n)) for n in (5, 15)})

    return roll(spark, sf, build, 14).select("event_id", "ma_5", "ma_15")


def lag_sql(x: str, n: int) -> str:
    return f"""CASE WHEN row_number() {over()} > {n} THEN lag({x}, {n}) {over()}
      WHEN count(*) OVER (PARTITION BY asset_id) > {n} THEN first_value({x}) {over()} END"""


@query(
    "lag_features",
    f"WITH {R_SQL} SELECT event_id, {lag_sql('value', 5)} AS lag_5, {lag_sql('value', 15)} AS lag_15 FROM r",
)
def lag_features(spark, sf):
    out = roll(spark, sf, lambda df, w, long: X.lagged(df, ["value"], [5, 15], w, long))
    return out.select("event_id", F.col("value_lag_5").alias("lag_5"), F.col("value_lag_15").alias("lag_15"))


@query(
    "rate_of_change",
    f"""WITH {R_SQL}, t AS (SELECT event_id, value, {lag_sql('value', 15)} AS l FROM r)
    SELECT event_id, round(coalesce((value - l) / 15.0, 0), 6) + 0.0 AS roc_15 FROM t""",
)
def rate_of_change(spark, sf):
    out = roll(spark, sf, lambda df, w, long: X.lagged(df, ["value"], [15], w, long))
    return out.select("event_id", r6(X.rate_of_change("value", "value_lag_15", 15)).alias("roc_15"))


@query(
    "rolling_min_max_range",
    f"""WITH {R_SQL} SELECT event_id, min(value) {over('14 PRECEDING')} AS min_15,
    max(value) {over('14 PRECEDING')} AS max_15,
    round(max(value) {over('14 PRECEDING')} - min(value) {over('14 PRECEDING')}, 6) AS range_15 FROM r""",
)
def rolling_min_max_range(spark, sf):
    def build(df, w, _):
        frame = w.rowsBetween(-14, 0)
        df = df.withColumns({"min_15": F.min("value").over(frame), "max_15": F.max("value").over(frame)})
        return df.withColumn("range_15", r6(F.col("max_15") - F.col("min_15")))

    return roll(spark, sf, build, 14).select("event_id", "min_15", "max_15", "range_15")


CROSS_SQL = {
    "TP2_TP3_diff": "TP2 - TP3",
    "TP2_TP3_ratio": "TP2 / (TP3 + 1e-6)",
    "work_per_pressure": "Motor_current / (TP2 + 1e-6)",
    "reservoir_drop": "Reservoirs - TP3",
}


@query(
    "cross_sensor",
    f"WITH {S_SQL} SELECT event_id, "
    + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in CROSS_SQL.items())
    + " FROM s",
)
def cross_sensor(spark, sf):
    out = X.cross_features(sensors(spark, sf))
    return out.select("event_id", *[r6(c).alias(c) for c in CROSS_SQL])


def full_sql() -> str:
    cols = {c: c for c in SENSORS}
    cols["TP2_delta"] = f"coalesce(TP2 - lag(TP2) {over()}, 0)"
    for x in ANALOGUE:
        cols[f"{x}_std_5"] = f"coalesce(stddev_samp({x}) {over('4 PRECEDING')}, 0)"
        cols[f"{x}_ma_5"] = f"avg({x}) {over('4 PRECEDING')}"
        cols[f"{x}_ma_15"] = f"avg({x}) {over('14 PRECEDING')}"
        cols[f"{x}_lag_5"], cols[f"{x}_lag_15"] = lag_sql(x, 5), lag_sql(x, 15)
        cols[f"{x}_roc_15"] = f"coalesce(({x} - {lag_sql(x, 15)}) / 15.0, 0)"
        low, high = f"min({x}) {over('14 PRECEDING')}", f"max({x}) {over('14 PRECEDING')}"
        cols[f"{x}_min_15"], cols[f"{x}_max_15"], cols[f"{x}_range_15"] = low, high, f"{high} - {low}"
    cols.update(CROSS_SQL)
    picks = ", ".join(f"round({cols[n]}, 6) + 0.0 AS {n}" for n in X.feature_names(True))
    return f"WITH {S_SQL} SELECT event_id, {picks} FROM s"


@query("full_features", full_sql())
def full_features(spark, sf):
    """All 80 model columns per asset, one exchange."""
    rows = sensors(spark, sf).select("event_id", "ts", "asset_id", *SENSORS)
    out = X.add_features(rows, "asset_id", gaps=False)
    return out.select("event_id", *[r6(n).alias(n) for n in X.feature_names(True)])


SNAP = {
    **{c: c for c in SENSORS},
    "TP2_delta": "0.0::DOUBLE",
    **{f"{x}_std_5": "0.0::DOUBLE" for x in ANALOGUE},
    **{f"{x}_ma_{n}": x for x in ANALOGUE for n in (5, 15)},
    **CROSS_SQL,
}


@query(
    "stateless_features",
    f"WITH {S_SQL} SELECT event_id, "
    + ", ".join(f"round({SNAP.get(n, '0.0::DOUBLE')}, 6) + 0.0 AS {n}" for n in X.feature_names(True))
    + " FROM s",
)
def stateless_features(spark, sf):
    """Features of a reading without history, aligned to the 80-column contract."""
    out = X.snapshot_features(sensors(spark, sf))
    names = X.feature_names(True)
    return X.align(out, names, ["event_id"]).select("event_id", *[r6(n).alias(n) for n in names])


ALIGN = ["LPS", "TP2", "Caudal_impulses", "H1", "TP2_lag_5"]


@query(
    "feature_alignment",
    f"""WITH {S_SQL} SELECT event_id, 1.0::DOUBLE AS LPS, TP2, 1.0::DOUBLE AS Caudal_impulses, H1,
    0.0::DOUBLE AS TP2_lag_5 FROM s""",
)
def feature_alignment(spark, sf):
    return X.align(sensors(spark, sf), ALIGN, ["event_id"])


@query("feature_set_select", f"WITH {S_SQL} SELECT event_id, {', '.join(SENSORS)} FROM s")
def feature_set_select(spark, sf):
    return X.select_set(sensors(spark, sf), "raw", ["event_id"])


def set_sql(names):
    return f"SELECT event_id, {', '.join(names)} FROM ({full_sql()})"


@query("feature_set_v1", set_sql(X.feature_names(False)))
def feature_set_v1(spark, sf):
    """The 34 columns of the first feature version."""
    rows = sensors(spark, sf).select("event_id", "ts", "asset_id", *SENSORS)
    out = X.select_set(X.add_features(rows, "asset_id", gaps=False), "v1", ["event_id"])
    return out.select("event_id", *[r6(n).alias(n) for n in X.feature_names(False)])


@query("transformer_features", set_sql(X.feature_names(False)))
def transformer_features(spark, sf):
    """The feature step as a pipeline stage: saved, loaded again, then applied."""
    path = f"{scratch(spark, 'stage')}/features"
    SensorFeatures(key=["asset_id"], enableV2=False).save(path)
    rows = sensors(spark, sf).select("event_id", "ts", "asset_id", *SENSORS)
    out = SensorFeatures.load(path).transform(rows)
    return out.select("event_id", *[r6(n).alias(n) for n in X.feature_names(False)])


@query("feature_set_v2", set_sql(X.feature_names(True)))
def feature_set_v2(spark, sf):
    """The 80 columns of the second feature version."""
    rows = sensors(spark, sf).select("event_id", "ts", "asset_id", *SENSORS)
    out = X.select_set(X.add_features(rows, "asset_id", gaps=False), "v2", ["event_id"])
    return out.select("event_id", *[r6(n).alias(n) for n in X.feature_names(True)])


@query(
    "reading_validation",
    f"""WITH {S_SQL}, b AS (
      SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE H1 END AS H1,
             CASE WHEN event_id % 13 = 0 THEN COMP + 1.5 ELSE COMP END AS COMP FROM s)
    SELECT event_id, H1 IS NOT NULL AND COMP BETWEEN 0 AND 1 AS is_valid,
      concat_ws('; ', CASE WHEN H1 IS NULL THEN 'missing H1' END,
        CASE WHEN NOT COMP BETWEEN 0 AND 1 THEN 'COMP outside 0..1' END) AS reasons FROM b""",
)
def reading_validation(spark, sf):
    bad = sensors(spark, sf).withColumns(
        {
            "H1": F.when(F.col("event_id") % 11 != 0, F.col("H1")),
            "COMP": F.when(F.col("event_id") % 13 == 0, F.col("COMP") + 1.5).otherwise(F.col("COMP")),
        }
    )
    out = X.validate_readings(bad)
    return out.select("event_id", "is_valid", F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "drop_consecutive_repeats",
    f"""WITH {R_SQL}, m AS (SELECT event_id, asset_id, CAST(ts AS DATE) AS d FROM r),
    p AS (SELECT *, lag(d) OVER (PARTITION BY asset_id ORDER BY event_id) AS before FROM m)
    SELECT event_id, asset_id FROM p WHERE before IS DISTINCT FROM d""",
)
def drop_consecutive_repeats(spark, sf):
    """Day-truncated time stamps repeat; arrival order is the event id."""
    rows = readings(spark, sf).select("event_id", "asset_id", F.to_date("ts").alias("d"))
    return X.drop_consecutive_repeats(rows, "asset_id", "d").select("event_id", "asset_id")


@query(
    "warm_flag",
    f"WITH {R_SQL} SELECT event_id, row_number() {over()} >= 16 AS is_warm FROM r",
)
def warm_flag(spark, sf):
    rows = readings(spark, sf).select("event_id", "ts", "asset_id")
    return X.warm_flag(rows).select("event_id", "is_warm")


@query(
    "halo_moving_average",
    f"""WITH {R_SQL} SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS 14 PRECEDING), 6) AS ma_15
    FROM r""",
)
def halo_moving_average(spark, sf):
    """The whole table as one series, cut into cells with copied borders."""
    rows = readings(spark, sf).select("event_id", "ts", "value")
    laid = lay_out(rows, (), target_rows=2000)
    return laid.roll(14, lambda df, w, _: df.withColumn("ma_15", r6(X.rolling_mean("value", w, 15)))).rows.select(
        "event_id", "ma_15"
    )


@query(
    "global_row_index",
    f"WITH {R_SQL} SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS rn FROM r",
)
def global_row_index(spark, sf):
    rows = readings(spark, sf).select("event_id", "ts")
    return lay_out(rows, (), target_rows=2000).index("rn").rows.select("event_id", "rn")


