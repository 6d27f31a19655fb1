from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions.scalar import softmax2
from faultlens.operators import evaluate as E
from faultlens.operators.windows import sliding_windows
from faultlens.plans.ranking import rank_in_class
from faultlens.queries.registry import L_SQL, R_SQL, labelled, query, r6, readings, table

T_SQL = R_SQL + """,
t AS (SELECT event_id, asset_id, CAST(event_type = 'error' AS INTEGER) AS y, value / 3 AS score,
      CAST(r.score >= 0.1 AS INTEGER) AS pred FROM r)"""


def scored(spark, sf):
    """Raw scores, outside of [0, 1] too, and a prediction."""
    return readings(spark, sf).select(
        "event_id",
        "asset_id",
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("value") / 3).alias("score"),
        (F.col("score") >= 0.1).cast("int").alias("pred"),
    )


@query(
    "confusion_matrix",
    """SELECT quality AS y, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1
    FROM labels GROUP BY quality""",
)
def confusion_matrix(spark, sf):
    return E.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


REPORT_SQL = """c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
   count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM {source}),
k AS (SELECT '1' AS cls, tp AS hit, fp AS wrong, fn AS missed, tp + fp + fn + tn AS n FROM c
      UNION ALL SELECT '0', tn, fn, fp, tp + fp + fn + tn FROM c),
m AS (SELECT cls, coalesce(hit / nullif(hit + wrong, 0), 0) AS precision, coalesce(hit / nullif(hit + missed, 0), 0) AS recall,
      coalesce(2.0 * hit / nullif(2 * hit + wrong + missed, 0), 0) AS f1, hit + missed AS support, hit, n FROM k)
SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(hit) / any_value(n), 6), round(sum(hit) / any_value(n), 6),
  round(sum(hit) / any_value(n), 6), any_value(n) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), any_value(n) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / any_value(n), 6),
  round(sum(recall * support) / any_value(n), 6), round(sum(f1 * support) / any_value(n), 6), any_value(n) FROM m"""


@query("classification_report", f"WITH {T_SQL}, " + REPORT_SQL.format(source="t"))
def classification_report(spark, sf):
    return E.classification_report(scored(spark, sf))


@query(
    "f1_gate",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
      count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
    SELECT round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, 2.0 * tp / (2 * tp + fp + fn) >= 0.75 AS passed FROM c""",
)
def f1_gate(spark, sf):
    return E.f1_gate(table(spark, sf, "labels"), "quality", "toxic")


CURVE_SQL = T_SQL + """,
g AS (SELECT score AS threshold, CAST(sum(y) AS BIGINT) AS tp, CAST(sum(1 - y) AS BIGINT) AS fp FROM t GROUP BY score),
v AS (SELECT threshold, tp, fp, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(fp) OVER w AS BIGINT) AS cum_fp,
      sum(tp) OVER () AS pos, sum(fp) OVER () AS neg
      FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cum_tp / (cum_tp + cum_fp) AS precision, cum_tp / pos AS recall FROM v)"""


@query(
    "pr_curve",
    f"""WITH {CURVE_SQL} SELECT threshold, cum_tp, cum_fp, round(precision, 6) AS precision, round(recall, 6) AS recall
    FROM c""",
)
def pr_curve(spark, sf):
    return E.pr_curve(scored(spark, sf))


@query(
    "roc_auc",
    f"""WITH {CURVE_SQL} SELECT round(sum(fp * (cum_tp - tp / 2)) / (any_value(pos) * any_value(neg)), 6) AS auc,
    CAST(any_value(pos) AS BIGINT) AS positives, CAST(any_value(neg) AS BIGINT) AS negatives FROM c""",
)
def roc_auc(spark, sf):
    return E.roc_auc(scored(spark, sf)).withColumn("auc", r6("auc"))


@query(
    "fbeta_threshold",
    f"""WITH {CURVE_SQL}, f AS (SELECT *, 5 * precision * recall / (4 * precision + recall + 1e-9) AS fbeta FROM c)
    SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fbeta, 6) AS fbeta
    FROM f ORDER BY round(fbeta, 9) DESC, threshold LIMIT 1""",
)
def fbeta_threshold(spark, sf):
    out = E.fbeta_threshold(scored(spark, sf))
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "fbeta")})


@query(
    "cv_summary",
    """WITH f AS (SELECT event_type, avg(value) AS a, CASE WHEN event_type <> 'view' THEN max(value) END AS b
      FROM events GROUP BY event_type)
    SELECT 'a' AS metric, round(avg(a), 4) AS mean, round(stddev_pop(a), 4) AS std,
      count(*) FILTER (a IS NULL) AS undefined_folds FROM f
    UNION ALL SELECT 'b', round(avg(b), 4), round(stddev_pop(b), 4), count(*) FILTER (b IS NULL) FROM f""",
)
def cv_summary(spark, sf):
    folds = readings(spark, sf).groupBy("event_type").agg(F.avg("value").alias("a"), F.max("value").alias("m"))
    folds = folds.withColumn("b", F.when(F.col("event_type") != "view", F.col("m")))
    return E.cv_summary(folds, ["a", "b"])


PERCENTILE_SQL = f"WITH {L_SQL} SELECT round(quantile_cont(TP2, 0.99), 6) AS threshold FROM l WHERE anomaly = 0"


@query("error_percentile_narrowed", PERCENTILE_SQL)
def error_percentile_narrowed(spark, sf):
    """The path of columns too long for one buffer."""
    value = E.error_threshold(labelled(spark, sf), "TP2", "anomaly", target_rows=100)
    return spark.createDataFrame([(value,)], "threshold double").select(r6("threshold").alias("threshold"))


@query("error_percentile", PERCENTILE_SQL)
def error_percentile(spark, sf):
    value = E.error_threshold(labelled(spark, sf), "TP2", "anomaly")
    return spark.createDataFrame([(value,)], "threshold double").select(r6("threshold").alias("threshold"))


@query(
    "separation_sigma",
    f"""WITH {L_SQL}, z AS (SELECT avg(TP2) FILTER (anomaly = 0) AS h, stddev_pop(TP2) FILTER (anomaly = 0) AS d,
      avg(TP2) FILTER (anomaly = 1) AS a FROM l)
    SELECT round(h, 6) AS healthy_mean, round(d, 6) AS healthy_std, round(a, 6) AS anomaly_mean,
      round((a - h) / (d + 1e-8), 6) AS separation_sigma FROM z""",
)
def separation_sigma(spark, sf):
    out = E.separation(labelled(spark, sf), "TP2", "anomaly")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "latency_percentiles",
    """SELECT count(value) AS n, round(quantile_cont(value, 0.5), 3) AS p50_ms, round(quantile_cont(value, 0.95), 3) AS p95_ms
    FROM events""",
)
def latency_percentiles(spark, sf):
    return E.timing_percentiles(readings(spark, sf), "value")


@query(
    "window_mse",
    f"""WITH {L_SQL},
    i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM l),
    w AS (SELECT unnest(range(0, (SELECT count(*) FROM l) - 59, 10)) AS lo),
    m AS (SELECT lo, TP2, TP3, avg(TP2) OVER (PARTITION BY lo) AS a, avg(TP3) OVER (PARTITION BY lo) AS b
          FROM w JOIN i ON rn BETWEEN lo AND lo + 59)
    SELECT CAST(lo // 10 AS BIGINT) AS wid, round(avg(((TP2 - a) ** 2 + (TP3 - b) ** 2) / 2), 4) AS mse FROM m GROUP BY lo""",
)
def window_mse(spark, sf):
    """Each window against its own channel means as the reconstruction."""
    w = sliding_windows(labelled(spark, sf), ["TP2", "TP3"])
    mean = lambda c: F.aggregate("x", F.lit(0.0), lambda s, row: s + row[c]) / 60
    w = w.withColumns({"m0": mean(0), "m1": mean(1)})
    flat = F.transform("x", lambda row: F.array(F.col("m0"), F.col("m1")))
    return w.select("wid", F.round(E.window_mse("x", flat), 4).alias("mse"))


@query(
    "parity_max_diff",
    f"""WITH {R_SQL} SELECT 'p' AS "column", count(*) AS n,
      round(max(abs(round(exp(b) / (exp(a) + exp(b)), 6) - exp(b) / (exp(a) + exp(b)))), 6) AS max_diff, true AS within
    FROM (SELECT value / 100 AS a, k / 100 AS b FROM r)""",
)
def parity_max_diff(spark, sf):
    """A score against its six-digit copy, matched by row key."""
    rows = readings(spark, sf).select(
        "event_id", softmax2(F.col("value") / 100, F.col("k") / 100).alias("p")
    )
    out = E.parity(rows, rows.withColumn("p", r6("p")), ["event_id"], ["p"])
    return out.withColumn("max_diff", r6("max_diff"))


FOLD_SQL = T_SQL + """,
o AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id), event_id) - 1) % 5 AS INTEGER)
      AS fold FROM t),
n AS (SELECT fold, count(*) AS n_val, sum(y) AS pos,
        coalesce(2.0 * count(*) FILTER (y = 1 AND score >= 20) /
          nullif(2 * count(*) FILTER (y = 1 AND score >= 20) + count(*) FILTER (y = 0 AND score >= 20)
            + count(*) FILTER (y = 1 AND score < 20), 0), 0) AS f1 FROM o GROUP BY fold),
g AS (SELECT fold, score AS thr, sum(y) AS tp, sum(1 - y) AS fp FROM o GROUP BY fold, score),
v AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY fold) AS p,
        sum(fp) OVER (PARTITION BY fold) AS q
      FROM g WINDOW w AS (PARTITION BY fold ORDER BY thr DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT fold, round(sum(fp * (ctp - tp / 2)) / (any_value(p) * any_value(q)), 4) AS roc_auc FROM v GROUP BY fold),
b AS (SELECT fold, thr, 2.0 * ctp / (ctp + cfp + p) AS f1t FROM v
      QUALIFY row_number() OVER (PARTITION BY fold ORDER BY
        round(5 * (ctp / (ctp + cfp)) * (ctp / p) / (4 * (ctp / (ctp + cfp)) + ctp / p + 1e-9), 9) DESC, thr) = 1)
SELECT fold, CAST(sum(n_val) OVER () - n_val AS BIGINT) AS n_train, n_val,
  round((sum(n_val) OVER () - n_val - (sum(pos) OVER () - pos)) / greatest(1, sum(pos) OVER () - pos), 4) AS pos_weight,
  round(f1, 4) AS f1_default, roc_auc, round(thr, 4) AS threshold_f2, round(f1t, 4) AS f1_tuned
FROM n JOIN a USING (fold) JOIN b USING (fold)"""


@query("pr_curve_by_ranges", f"""WITH {CURVE_SQL} SELECT threshold, cum_tp, cum_fp FROM c""")
def pr_curve_by_ranges(spark, sf):
    """The path of more distinct scores than one task sums up."""
    return E.score_curve(scored(spark, sf), range_rows=300).select("threshold", "cum_tp", "cum_fp")


@query("fold_metrics", f"WITH {FOLD_SQL}")
def fold_metrics(spark, sf):
    ranked = rank_in_class(scored(spark, sf), "y", "event_id")
    folds = ranked.withColumn("fold", (F.col("rank") % 5).cast("int"))
    return E.fold_metrics(folds, cut=20.0)
