from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import profile as P
from faultlens.queries.registry import L_SQL, R_SQL, labelled, query, r6, readings
from faultlens.schema import ANALOGUE, SENSORS

THREE = ["TP2", "TP3", "H1"]


def stack_sql(columns, body: str, source: str = "l") -> str:
    """One SELECT per column; {c} is the column."""
    return "\nUNION ALL ".join(f"SELECT '{c}' AS {{name}}, {body.replace('{c}', c)} FROM {source}" for c in columns)


DESCRIBE_SQL = (
    f"WITH {L_SQL} "
    + stack_sql(
        ANALOGUE,
        """count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max""",
    ).replace("{name}", '"column"')
)


@query("describe_numeric_narrowed", DESCRIBE_SQL)
def describe_numeric_narrowed(spark, sf):
    """The path of columns too long for one buffer."""
    out = P.describe_numeric(labelled(spark, sf), ANALOGUE, target_rows=100)
    return out.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query("describe_numeric", DESCRIBE_SQL)
def describe_numeric(spark, sf):
    out = P.describe_numeric(labelled(spark, sf), ANALOGUE)
    return out.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "describe_text",
    """WITH c AS (SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY 2
      UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY 2)
    SELECT "column", CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique,
      first(value ORDER BY n DESC, value) AS top, max(n) AS freq FROM c GROUP BY "column" """,
)
def describe_text(spark, sf):
    return P.describe_text(readings(spark, sf), ["event_type", "props"])


NULLS_SQL = R_SQL + """,
l AS (SELECT CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 10 <> 0 THEN k END AS k, score FROM r)"""


@query(
    "null_profile",
    f"WITH {NULLS_SQL}, p AS ("
    + stack_sql(
        ["value", "k", "score"],
        "count(*) - count({c}) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct",
    ).replace("{name}", '"column"')
    + ") SELECT * FROM p WHERE n_null > 0",
)
def null_profile(spark, sf):
    e = F.col("event_id")
    rows = readings(spark, sf).select(
        F.when(e % 3 != 0, F.col("value")).alias("value"), F.when(e % 10 != 0, F.col("k")).alias("k"), "score"
    )
    return P.null_profile(rows, ["value", "k", "score"])


@query(
    "column_purity",
    f"""WITH {R_SQL}, u AS (
      SELECT 'event_type' AS "column", event_type AS value FROM r
      UNION ALL SELECT 'k', CAST(CAST(k AS INTEGER) AS VARCHAR) FROM r
      UNION ALL SELECT 'fixed', 'x' FROM r
      UNION ALL SELECT 'sparse', CASE WHEN event_id % 4 = 0 THEN 'y' END FROM r),
    c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT count(*) AS total FROM r)
    SELECT "column", first(value ORDER BY n DESC, value) AS top_value, max(n) AS top_n, count(*) AS n_distinct,
      round(max(n) * 100.0 / any_value(total), 4) AS pct,
      CASE WHEN max(n) = any_value(total) THEN 'constant' WHEN max(n) * 100.0 / any_value(total) > 99.9
        THEN 'quasi-constant' ELSE 'varying' END AS flag
    FROM c, t GROUP BY "column" """,
)
def column_purity(spark, sf):
    rows = readings(spark, sf).select(
        "event_type",
        F.col("k").cast("int").alias("k"),
        F.lit("x").alias("fixed"),
        F.when(F.col("event_id") % 4 == 0, "y").alias("sparse"),
    )
    return P.column_purity(rows, ["event_type", "k", "fixed", "sparse"])


@query(
    "label_correlation",
    f"WITH {L_SQL}, f AS (SELECT *, 1.0 AS steady FROM l) "
    + stack_sql([*SENSORS], "round(corr({c}, anomaly), 6) + 0.0 AS r", "f").replace("{name}", '"column"')
    + "\nUNION ALL SELECT 'steady', NULL",
)
def label_correlation(spark, sf):
    """A column without spread has no correlation: NULL, not an error."""
    rows = labelled(spark, sf).withColumn("steady", F.lit(1.0))
    return P.label_correlation(rows, [*SENSORS, "steady"])


def pair_sql(upper: bool) -> str:
    picks = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM l"
        for i, a in enumerate(ANALOGUE)
        for j, b in enumerate(ANALOGUE)
        if (i < j or not upper)
    ]
    return "\nUNION ALL ".join(picks)


@query("correlation_matrix", f"WITH {L_SQL} {pair_sql(False)}")
def correlation_matrix(spark, sf):
    return P.correlation_matrix(labelled(spark, sf), ANALOGUE)


@query("top_correlations", f"WITH {L_SQL}, p AS ({pair_sql(True)}) SELECT * FROM p ORDER BY r DESC, a, b LIMIT 10")
def top_correlations(spark, sf):
    return P.top_correlations(labelled(spark, sf), ANALOGUE)


@query(
    "histogram_60",
    f"WITH {L_SQL}, h AS ("
    + stack_sql(
        ANALOGUE,
        """CAST(least(floor(({c} - (SELECT min({c}) FROM l)) /
        (((SELECT max({c}) FROM l) - (SELECT min({c}) FROM l)) / 60)), 59) AS INTEGER) AS bin""",
    ).replace("{name}", '"column"')
    + ') SELECT "column", bin, count(*) AS n FROM h GROUP BY 1, 2',
)
def histogram_60(spark, sf):
    return P.histogram(labelled(spark, sf), ANALOGUE)


# The sensors whose outliers are reported.
KEY_SENSORS = ["TP2", "TP3", "H1", "DV_pressure", "Motor_current"]


IQR_SQL = (
    f"WITH {L_SQL}, q AS ("
    + stack_sql(
        KEY_SENSORS, "quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b"
    ).replace("{name}", "sensor")
    + "), u AS ("
    + stack_sql(KEY_SENSORS, "{c} AS x").replace("{name}", "sensor")
    + """) SELECT sensor, round(any_value(a), 4) AS q1, round(any_value(b), 4) AS q3, round(any_value(b - a), 4) AS iqr,
      round(any_value(a - 1.5 * (b - a)), 4) AS lower_fence, round(any_value(b + 1.5 * (b - a)), 4) AS upper_fence,
      count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS n_outliers,
      round(100.0 * count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) / count(*), 4) AS pct
    FROM u JOIN q USING (sensor) GROUP BY sensor"""
)


@query("iqr_outliers_narrowed", IQR_SQL)
def iqr_outliers_narrowed(spark, sf):
    """The path of columns too long for one buffer."""
    return P.iqr_outliers(labelled(spark, sf), KEY_SENSORS, target_rows=100)


@query("iqr_outliers", IQR_SQL)
def iqr_outliers(spark, sf):
    return P.iqr_outliers(labelled(spark, sf), KEY_SENSORS)


@query(
    "class_balance",
    f"""WITH {L_SQL}, c AS (SELECT anomaly, count(*) AS n FROM l GROUP BY anomaly)
    SELECT anomaly, n, round(max(n) OVER () / min(n) OVER (), 6) AS imbalance FROM c""",
)
def class_balance(spark, sf):
    return P.class_balance(labelled(spark, sf), "anomaly")


@query("distinct_days", "SELECT count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events")
def distinct_days(spark, sf):
    return P.distinct_days(readings(spark, sf))
