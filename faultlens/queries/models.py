from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.operators import crossval as X
from faultlens.operators import evaluate as E
from faultlens.operators import registry as R
from faultlens.operators import training as M
from faultlens.operators import windows as V
from faultlens.operators.features import add_features, feature_names
from faultlens.operators.sampling import smote, stratified_split
from faultlens.operators.scoring import SensorFeatures, score_with
from faultlens.queries.registry import R_SQL, query, readings, sensors, table
from faultlens.schema import ANALOGUE, SENSORS
from faultlens.session import cut

KEEP = ["event_id", "y"]

# A fault needs a high product of two sensors; no single column tells it.
FAULT_SQL = R_SQL + """,
t AS (SELECT event_id, CAST(value * k >= 4000 AS INTEGER) AS y FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id), event_id) - 1 AS rank,
      count(*) OVER (PARTITION BY y) AS n FROM t)"""
# Fitted scores differ by engine; what must hold is which rows are scored, the range, and the gate.
TEST_SQL = f"""WITH {FAULT_SQL} SELECT event_id, y, true AS in_range, true AS passed FROM h
    WHERE rank < floor(n * 0.2 + 0.5)"""


def faulty(spark, sf):
    return sensors(spark, sf).withColumn("y", (F.col("TP2") * F.col("TP3") >= 4000).cast("int"))


def modelled(spark, sf, v2=False):
    """34 or 80 features per reading."""
    spec = SensorFeatures(key=["asset_id"], enableV2=v2).spec()
    feats = add_features(faulty(spark, sf), "asset_id", spec=spec, gaps=False)
    # Fitting reads its input several times; the features are computed once.
    return cut(stratified_split(feats, "y", "event_id"))


def split(spark, sf, v2=False):
    rows = modelled(spark, sf, v2)
    return rows.where("NOT is_test"), rows.where("is_test")


def gated(scores):
    """Scored rows, whether each score is a probability, and whether F1 passes the gate."""
    scores = cut(scores.withColumn("pred", (F.col("score") >= 0.5).cast("int")))
    passed = E.f1_gate(scores).first()["passed"]
    return scores.select(*KEEP, F.col("score").between(0, 1).alias("in_range"), F.lit(passed).alias("passed"))


@query("forest_scores", TEST_SQL)
def forest_scores(spark, sf):
    train, test = split(spark, sf, v2=True)
    model = M.train_forest(train, feature_names(True), numTrees=20, maxDepth=8)
    return gated(M.score(model, test, KEEP))


@query(
    "forest_grid_search",
    """SELECT CAST(t AS INTEGER) AS num_trees, CAST(d AS INTEGER) AS max_depth, true AS passed
    FROM (SELECT unnest([100, 200]) AS t), (SELECT unnest([10, 15, 20]) AS d)""",
)
def forest_grid_search(spark, sf):
    """The whole grid over folds; the training side of each fold is balanced by synthetic rows."""
    rows = modelled(spark, sf).where("NOT is_test")
    names = feature_names(False)

    def unpack(df):
        return df.select("event_id", "y", *[F.element_at("v", i + 1).alias(c) for i, c in enumerate(names)])

    def resample(train):
        packed = train.select("event_id", "y", F.array(*names).alias("v"))
        return unpack(smote(packed, "v", "y", "event_id"))

    trials = M.search(
        rows.select("event_id", "y", *names),
        lambda df, p: M.train_forest(df, names, weighted=False, **p),
        M.grid({"numTrees": [100, 200], "maxDepth": [10, 15, 20]}),
        "y",
        "event_id",
        folds=3,
        resample=resample,
    )
    out = [(t.params["numTrees"], t.params["maxDepth"], t.mean >= E.GATE_F1) for t in trials]
    return spark.createDataFrame(out, "num_trees int, max_depth int, passed boolean")


@query("boosted_scores", TEST_SQL)
def boosted_scores(spark, sf):
    """Twenty-seven drawn candidates halved to one while their rounds grow; the last is fitted with its drawn rounds."""
    names = feature_names(False)
    train, test = split(spark, sf)

    def fit(rows, params):
        rows = stratified_split(rows.drop("is_test"), "y", "event_id", 0.1).withColumnRenamed("is_test", "is_validation")
        return M.train_boosted(rows, names, validation="is_validation", **params)

    best = M.halving_search(train, fit, M.random_candidates(27), "y", "event_id", first=2, rows=M.SEARCH_ROWS)[0]
    return gated(M.score(fit(train, best.params), test, KEEP))


@query("mlp_scores", TEST_SQL)
def mlp_scores(spark, sf):
    train, test = split(spark, sf)
    names = feature_names(False)
    stats = V.fit_columns(train, names)
    balanced = M.replicate_minority(V.standardize_columns(train, stats), "y")
    model = M.train_mlp(balanced, names)
    return gated(M.score(model, V.standardize_columns(test, stats), KEEP))


# A fault raises one pressure for 120 readings; a window is faulty if it holds such a reading.
WINDOWS_SQL = f"""{R_SQL},
i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, CAST((event_id // 120) % 5 = 0 AS INTEGER) AS fault FROM r),
w AS (SELECT unnest(range(0, (SELECT count(*) FROM r) - 59, 10)) AS lo),
m AS (SELECT CAST(lo // 10 AS BIGINT) AS wid, max(fault) AS y, CAST(min(ts) AS DATE) AS day FROM w JOIN i ON rn BETWEEN lo AND lo + 59 GROUP BY lo),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || wid), wid) - 1) % 5 AS INTEGER) AS fold FROM m)"""
DAY_FOLDS_SQL = """d AS (SELECT *, row_number() OVER (ORDER BY n DESC, day) AS i FROM (SELECT day, count(*) AS n FROM m GROUP BY 1)),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS DATE) AS day, CAST(NULL AS INTEGER) AS fold
      UNION ALL
      SELECT d.i, list_transform(load, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN d.n ELSE 0 END),
        d.day, CAST(list_position(load, list_min(load)) - 1 AS INTEGER) FROM g JOIN d ON d.i = g.i + 1),
b AS (SELECT wid, y, fold FROM m JOIN g USING (day))"""


def tensors(spark, sf):
    fault = (F.floor(F.col("event_id") / 120) % 5 == 0).cast("int")
    rows = sensors(spark, sf).withColumn("fault", fault).withColumn("TP2", F.col("TP2") + 3000 * F.col("fault"))
    return V.sliding_windows(rows, SENSORS, label="fault")


def gated_windows(spark, sf, fit):
    """Every window scored by the model of its day's fold, and whether F1 over all of them passes the gate."""
    scored = X.score_folds(cut(X.place(X.prepared(tensors(spark, sf), fit), "by_day", 5, 5)), fit, 5)
    passed = E.f1_gate(scored.withColumn("pred", (F.col("score") >= 0.5).cast("int"))).first()["passed"]
    return scored.select("wid", "y", F.col("score").between(0, 1).alias("in_range"), F.lit(passed).alias("passed"))


WINDOW_TEST_SQL = f"WITH {WINDOWS_SQL} SELECT wid, y, true AS in_range, true AS passed FROM m"


@query("window_classifier_scores", WINDOW_TEST_SQL)
def window_classifier_scores(spark, sf):
    return gated_windows(spark, sf, X.window_forest(len(SENSORS), numTrees=10, maxDepth=5))


@query("window_patch_classifier_scores", WINDOW_TEST_SQL)
def window_patch_classifier_scores(spark, sf):
    return gated_windows(spark, sf, X.window_forest(len(SENSORS), kind="patches", numTrees=20, maxDepth=6))


@query("pca_reconstruction_scores", WINDOW_TEST_SQL)
def pca_reconstruction_scores(spark, sf):
    """Windows whose error is over the threshold of healthy windows that were held back score 0.5 and more."""
    return gated_windows(spark, sf, X.window_reconstruction(len(SENSORS), 8))


@query(
    "fold_evaluation",
    f"""WITH RECURSIVE {WINDOWS_SQL}, {DAY_FOLDS_SQL},
    near AS (SELECT DISTINCT x.wid, z.fold FROM b x JOIN b z ON z.wid BETWEEN x.wid - 5 AND x.wid + 5),
    a AS (SELECT 'stratified' AS scheme, wid, y, fold, f.fold AS near FROM f UNION ALL SELECT 'by_day', b.wid, b.y, b.fold, near.fold FROM b JOIN near USING (wid)),
    s AS (SELECT scheme, fold, count(DISTINCT wid) AS n_val FROM a GROUP BY ALL),
    t AS (SELECT s.scheme, s.fold, w.wid, w.y FROM s JOIN (SELECT scheme, wid, y, list(near) AS near FROM a GROUP BY ALL) w
          ON w.scheme = s.scheme AND NOT list_contains(w.near, s.fold))
    SELECT s.scheme, s.fold, count(*) AS n_train, n_val, round(CAST(count(*) - sum(y) AS DOUBLE) / greatest(1, sum(y)), 4) AS pos_weight, true AS passed
    FROM s JOIN t ON s.scheme = t.scheme AND s.fold = t.fold GROUP BY ALL""",
)
def fold_evaluation(spark, sf):
    """Scaler and forest fitted per fold, stratified and by day with overlapping windows purged."""
    folds, _ = X.evaluate(tensors(spark, sf), X.window_forest(len(SENSORS), numTrees=10, maxDepth=5))
    return folds.select("scheme", "fold", "n_train", "n_val", "pos_weight", "passed")


class RatioPredictor:
    """A stand-in for a user's model: class-to-probability maps from two sensors."""

    feature_names_in_ = ["TP2", "TP3"]

    def predict_proba(self, rows):
        p = rows["TP2"] / (rows["TP2"] + rows["TP3"] + 1.0)
        return [{0: 1.0 - v, 1: v} for v in p]


@query(
    "plugin_scores",
    """WITH r AS (SELECT event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)
    SELECT event_id, round(value / (value + k + 1.0), 6) AS probability,
      CAST(round(value / (value + k + 1.0), 6) >= 0.5 AS INTEGER) AS predicted_class FROM r""",
)
def plugin_scores(spark, sf):
    return score_with(sensors(spark, sf), RatioPredictor, RatioPredictor.feature_names_in_, ["event_id"])


@query(
    "feature_importance",
    f"""SELECT unnest([{", ".join(f"'{c}'" for c in SENSORS)}]) AS feature, unnest([{", ".join(str(c in ANALOGUE).lower() for c in SENSORS)}]) AS leads, true AS shares""",
)
def feature_importance(spark, sf):
    """The fault follows from pressures and not from switches: the analogue sensors lead, and shares sum to 1."""
    model = M.train_forest(faulty(spark, sf), SENSORS, weighted=False, numTrees=50, maxDepth=5)
    found = M.feature_importance(model, SENSORS, spark)
    total = found.agg(F.sum("importance")).first()[0]
    place = F.row_number().over(W.orderBy(F.desc("importance"), "feature"))  # one row per feature
    return found.select("feature", (place <= len(ANALOGUE)).alias("leads"), F.lit(abs(total - 1) < 1e-6).alias("shares"))


RUNS_SQL = """runs AS (SELECT event_type AS experiment, 'run-' || user_id AS run_id, round(max(value), 6) AS f1
  FROM events GROUP BY event_type, user_id)"""


def runs(spark, sf):
    """Each (event type, asset) as an experiment run with two metrics."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("experiment"), F.concat(F.lit("run-"), F.col("user_id")).alias("run_id")).agg(
        F.create_map(F.lit("f1"), F.round(F.max("value"), 6), F.lit("n"), F.count("*").cast("double")).alias("metrics")
    )


@query(
    "champion_run",
    f"WITH {RUNS_SQL} SELECT run_id, f1 AS value FROM runs WHERE experiment = 'error' ORDER BY f1 DESC, run_id LIMIT 1",
)
def champion_run(spark, sf):
    return R.best_run(runs(spark, sf), "error", "f1")


def cards(spark, sf):
    return readings(spark, sf).groupBy(F.col("event_type").alias("model_name")).agg(
        F.round(F.avg("score"), 6).cast("string").alias("decision_threshold"), F.count("*").alias("n_train")
    )


@query(
    "promoted_card",
    f"""WITH {R_SQL}, {RUNS_SQL}, best AS (SELECT run_id FROM runs WHERE experiment = 'view' ORDER BY f1 DESC, run_id LIMIT 1)
    SELECT event_type AS model_name, count(*) AS n_train,
      CASE WHEN event_type = 'view' THEN (SELECT run_id FROM best) END AS promoted_run_id FROM r GROUP BY event_type""",
)
def promoted_card(spark, sf):
    run = R.best_run(runs(spark, sf), "view", "f1").first()["run_id"]
    return R.promote(cards(spark, sf), "view", run).select("model_name", "n_train", "promoted_run_id")


@query(
    "model_status",
    """SELECT m AS model_name, m IN (SELECT event_type FROM events WHERE value > 1) AS ready, m = 'error' AS active
    FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'absent']) AS m)""",
)
def model_status(spark, sf):
    known = ["click", "error", "purchase", "signup", "view", "absent"]
    ready = readings(spark, sf).where("value > 1").select(F.col("event_type").alias("model_name"))
    return R.model_status(ready, known, R.switch_model(" Error ", known))


