from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import windows as V
from faultlens.operators.labels import healthy_faulty_split
from faultlens.operators.sampling import group_folds
from faultlens.queries.registry import INTERVALS, L_SQL, S_SQL, labelled, query, r6, sensors
from faultlens.schema import SENSORS

CHANNELS_SQL = ", ".join(SENSORS)
# i: rows by position; w: window starts; m: window members in order.
WINDOWS_SQL = L_SQL + """,
i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM l),
w AS (SELECT unnest(range(0, (SELECT count(*) FROM l) - 59, 10)) AS lo),
m AS (SELECT CAST(lo // 10 AS BIGINT) AS wid, rn - lo AS t, i.* FROM w JOIN i ON rn BETWEEN lo AND lo + 59)"""


def windows(spark, sf, columns=SENSORS):
    return V.sliding_windows(labelled(spark, sf), columns, label="anomaly")


@query(
    "sliding_windows",
    f"""WITH {WINDOWS_SQL} SELECT wid, max(anomaly) AS y, count(*) AS n_rows,
    [{", ".join(f"round(sum({c}), 6)" for c in SENSORS)}] AS sums,
    [{", ".join(f"round(sum({c} * (t + 1)), 4)" for c in SENSORS)}] AS weighted,
    min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY wid""",
)
def sliding_windows(spark, sf):
    """The position-weighted sum is wrong unless each tensor is whole and in order."""
    channels = F.sequence(F.lit(0), F.lit(len(SENSORS) - 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    sums = F.transform(channels, lambda c: r6(total(F.transform("x", lambda row: F.get(row, c)))))
    weighted = F.transform(channels, lambda c: F.round(total(F.transform("x", lambda row, i: F.get(row, c) * (i + 1))), 4))
    return windows(spark, sf).select(
        "wid",
        "y",
        F.size("x").cast("bigint").alias("n_rows"),
        sums.alias("sums"),
        weighted.alias("weighted"),
        "first_ts",
        "last_ts",
    )


@query(
    "sliding_windows_per_asset",
    f"""WITH {L_SQL},
    i AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts, event_id) - 1 AS rn FROM l),
    m AS (SELECT asset_id, CAST(rn - o AS BIGINT) // 5 AS wid, i.TP2, i.anomaly
          FROM i, (SELECT unnest(range(0, 20)) AS o) WHERE rn >= o AND (rn - o) % 5 = 0)
    SELECT asset_id, CAST(wid AS BIGINT) AS wid, max(anomaly) AS y, round(sum(TP2), 6) AS sum_tp2
    FROM m GROUP BY asset_id, wid HAVING count(*) = 20""",
)
def sliding_windows_per_asset(spark, sf):
    w = V.sliding_windows(labelled(spark, sf), ["TP2"], "asset_id", length=20, stride=5, label="anomaly")
    total = F.aggregate("x", F.lit(0.0), lambda s, row: s + row[0])
    return w.select("asset_id", "wid", "y", r6(total).alias("sum_tp2"))


@query(
    "window_left_pad",
    f"""WITH {L_SQL},
    a AS (SELECT asset_id, list(TP2 ORDER BY ts, event_id) AS x FROM l GROUP BY asset_id)
    SELECT asset_id, CASE WHEN len(x) >= 60 THEN x[len(x) - 59 : len(x)]
      ELSE list_concat(list_transform(range(0, 60 - len(x)), lambda z: x[1]), x) END AS padded FROM a""",
)
def window_left_pad(spark, sf):
    """The newest 60 readings per asset as one window; short histories are padded."""
    from faultlens.operators.history import last_n

    newest = last_n(sensors(spark, sf).select("event_id", "ts", "asset_id", "TP2"), 60)
    buffers = newest.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "TP2"))).alias("b"))
    rows = F.transform("b", lambda r: F.array(r["TP2"]))
    return buffers.select("asset_id", F.flatten(V.left_pad(rows, 60)).alias("padded"))


@query(
    "window_patches",
    f"""WITH {WINDOWS_SQL}, c AS (SELECT wid, [{", ".join(f"list({c} ORDER BY t)" for c in SENSORS)}] AS a FROM m GROUP BY wid),
    p AS (SELECT wid, CAST(unnest(range(0, 9)) AS INTEGER) AS patch, a FROM c)
    SELECT wid, patch, flatten(list_transform(a, lambda x: x[patch * 6 + 1 : patch * 6 + 12])) AS token FROM p""",
)
def window_patches(spark, sf):
    w = windows(spark, sf)
    return w.select("wid", F.posexplode(V.patches("x", len(SENSORS))).alias("patch", "token"))


@query(
    "window_flatten",
    f"""WITH {WINDOWS_SQL} SELECT wid, flatten(list([{CHANNELS_SQL}] ORDER BY t)) AS flat FROM m GROUP BY wid""",
)
def window_flatten(spark, sf):
    flat = V.flatten_window("x")
    return windows(spark, sf).select("wid", V.flatten_window(V.unflatten_window(flat, len(SENSORS))).alias("flat"))


@query(
    "window_day_group",
    f"""WITH {WINDOWS_SQL},
    g AS (SELECT wid, CAST(min(ts) AS DATE) AS day, max(anomaly) AS y FROM m GROUP BY wid),
    f AS (SELECT CAST(ts AS DATE) AS day, CAST(day(min(ts)) % 5 AS INTEGER) AS fold FROM l GROUP BY 1)
    SELECT fold, count(*) AS n_windows, CAST(sum(y) AS BIGINT) AS n_faulty FROM g JOIN f USING (day) GROUP BY fold""",
)
def window_day_group(spark, sf):
    """Window -> day of its first row -> fold of that day."""
    rows = labelled(spark, sf)
    folds = rows.select(F.to_date("ts").alias("day")).distinct().withColumn("fold", F.dayofmonth("day") % 5)
    w = V.windows_by_day(windows(spark, sf), drop_cross_day=False)
    return (
        V.fold_of_window(w, folds)
        .groupBy("fold")
        .agg(F.count("*").alias("n_windows"), F.sum("y").alias("n_faulty"))
    )


@query(
    "windows_within_day",
    f"""WITH {WINDOWS_SQL} SELECT day, count(*) AS n FROM (
      SELECT wid, CAST(min(ts) AS DATE) AS day FROM m GROUP BY wid HAVING CAST(min(ts) AS DATE) = CAST(max(ts) AS DATE)
    ) GROUP BY day""",
)
def windows_within_day(spark, sf):
    return V.windows_by_day(windows(spark, sf)).groupBy("day").agg(F.count("*").alias("n"))


@query(
    "group_folds_by_day",
    f"""WITH RECURSIVE {S_SQL},
    d AS (SELECT *, row_number() OVER (ORDER BY n DESC, day) AS i
          FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM s GROUP BY 1)),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS DATE) AS day,
            CAST(NULL AS INTEGER) AS fold, CAST(NULL AS BIGINT) AS n
          UNION ALL
          SELECT d.i, list_transform(load, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN d.n ELSE 0 END),
            d.day, CAST(list_position(load, list_min(load)) - 1 AS INTEGER), d.n
          FROM g JOIN d ON d.i = g.i + 1)
    SELECT day, fold, n FROM g WHERE i > 0""",
)
def group_folds_by_day(spark, sf):
    days = sensors(spark, sf).select(F.to_date("ts").alias("day"))
    return group_folds(days, "day")


@query(
    "circular_zip_blend",
    f"""WITH {L_SQL},
    a AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM l WHERE anomaly = 0),
    b AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS j, count(*) OVER () AS n FROM l WHERE anomaly = 1)
    SELECT a.event_id, CAST(i + 1 AS BIGINT) AS step, round(least((i + 1) / 300.0, 1.0), 6) AS drift,
      {", ".join(f"round(a.{c} + least((i + 1) / 300.0, 1.0) * (b.{c} - a.{c}), 6) + 0.0 AS {c}" for c in SENSORS)}
    FROM a JOIN b ON i % b.n = j""",
)
def circular_zip_blend(spark, sf):
    healthy, faulty = healthy_faulty_split(sensors(spark, sf), INTERVALS)
    out = V.circular_blend(healthy, faulty, SENSORS)
    return out.select("event_id", "step", r6("drift").alias("drift"), *[r6(c).alias(c) for c in SENSORS])


@query(
    "drift_ramp",
    f"""WITH {L_SQL},
    c AS (SELECT *, CASE WHEN lag(anomaly) OVER (ORDER BY ts, event_id) IS DISTINCT FROM anomaly THEN 1 ELSE 0 END AS ch
          FROM l),
    g AS (SELECT *, sum(ch) OVER (ORDER BY ts, event_id) AS seg FROM c)
    SELECT event_id, round(least(row_number() OVER (PARTITION BY seg ORDER BY ts, event_id) / 300.0, 1.0), 6) AS drift
    FROM g""",
)
def drift_ramp(spark, sf):
    rows = labelled(spark, sf).select("event_id", "ts", "anomaly")
    return V.drift_ramp(rows, "anomaly").select("event_id", r6("drift").alias("drift"))
