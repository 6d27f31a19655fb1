import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from faultlens.operators import crossval as X
from faultlens.operators import registry as R
from faultlens.operators import training as M
from faultlens.operators.evaluate import f1_gate
from faultlens.operators.sampling import stratified_split
from faultlens.operators.scoring import class_one, score_with
from faultlens.operators.windows import standardize_window, window_scaler
from faultlens.sources.cards import read_cards, write_cards

NAMES = [f"sensor_{i}" for i in range(4)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    rows = [(i, 0, *rng.normal(0, 1, 4).tolist()) for i in range(400)]
    rows += [(400 + i, 1, *rng.normal(3, 0.5, 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, y int, " + ", ".join(f"{c} double" for c in NAMES))
    return stratified_split(df, "y", "id").cache()


@pytest.mark.parametrize("kind", ["forest", "boosted", "mlp"])
def test_models_pass_the_gate_on_separable_classes(data, kind):
    train, test = data.where("NOT is_test"), data.where("is_test")
    if kind == "forest":
        model = M.train_forest(train, NAMES, numTrees=10, maxDepth=4)
    elif kind == "boosted":
        flagged = stratified_split(train.drop("is_test"), "y", "id", 0.1).withColumnRenamed("is_test", "hold")
        model = M.train_boosted(flagged, NAMES, validation="hold", maxIter=5, maxDepth=3)
    else:
        model = M.train_mlp(M.replicate_minority(train, "y"), NAMES, hidden=[8], maxIter=30)
    scored = M.score(model, test, ["id", "y"]).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    assert scored.where("NOT score BETWEEN 0 AND 1").isEmpty()
    assert f1_gate(scored).first()["passed"]


def test_search_resamples_training_sides_only(data):
    seen = []

    def resample(train):
        seen.append(train.count())
        return train

    fit = lambda df, p: M.train_forest(df, NAMES, weighted=False, **p)
    trials = M.search(data.drop("is_test"), fit, M.grid({"numTrees": [2], "maxDepth": [1, 3]}), "y", "id", 2, resample)
    assert seen == [230, 230] and trials[0].mean >= trials[1].mean and len(trials[0].f1) == 2


def test_candidates_are_seeded_and_inside_the_ranges():
    a, b = M.random_candidates(20), M.random_candidates(20)
    assert a == b != M.random_candidates(20, seed=1)
    for p in a:
        for name, (low, high, kind) in M.BOOSTED_RANGES.items():
            assert low <= float(p[name]) <= high
    assert len(M.grid(M.FOREST_GRID)) == 6


def test_importance_sums_to_one(spark, data):
    model = M.train_forest(data, NAMES, weighted=False, numTrees=5, maxDepth=3)
    rows = M.feature_importance(model, NAMES, spark).collect()
    assert abs(sum(r["importance"] for r in rows) - 1) < 1e-9
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_reconstruction_errors_are_higher_off_the_healthy_plane(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1, 6, 2))
    healthy = [(i, 0, (base[0] * rng.normal()).tolist()) for i in range(60)]
    faulty = [(100 + i, 1, rng.normal(size=(6, 2)).tolist()) for i in range(10)]
    df = spark.createDataFrame(healthy + faulty, "wid bigint, y int, x array<array<double>>")
    model = M.train_reconstruction(df, 2, k=1)
    got = {r["y"]: r["e"] for r in model.errors(df).groupBy("y").agg(F.avg("error").alias("e")).collect()}
    assert got[0] < 1e-6 < got[1]
    with pytest.raises(ValueError):
        M.train_reconstruction(df.where("y = 1"), 2)


def test_both_probability_shapes():
    assert class_one(np.array([[0.3, 0.7], [0.9, 0.1]]), 2).tolist() == [0.7, 0.1]
    assert class_one([{0: 0.3, 1: 0.7}], 1).tolist() == [0.7]
    assert class_one([{"0": 0.3, "1": 0.7}], 1).tolist() == [0.7]
    with pytest.raises(ValueError):
        class_one(np.array([0.1, 0.2]), 2)


def test_plugged_in_model_gets_aligned_columns(spark):
    class Halves:
        feature_names_in_ = ["a", "LPS"]

        def predict_proba(self, rows):
            p = rows["a"].to_numpy() * rows["LPS"].to_numpy() / 2
            return np.column_stack([1 - p, p])

    df = spark.createDataFrame([(1, 1.0, 9.0), (2, 0.5, 9.0)], "id int, a double, other double")
    got = [tuple(r) for r in score_with(df, Halves, Halves.feature_names_in_, ["id"]).orderBy("id").collect()]
    assert got == [(1, 0.5, 1), (2, 0.25, 0)]


def test_champion_promotion_and_cards(spark, tmp_path):
    runs = spark.createDataFrame(
        [("r1", "e", {"f1": 0.8}), ("r2", "e", {"f1": 0.9}), ("r3", "e", {"auc": 1.0}), ("r4", "other", {"f1": 1.0})],
        "run_id string, experiment string, metrics map<string,double>",
    )
    best = R.best_run(runs, "e", "f1").first()
    assert (best["run_id"], best["value"]) == ("r2", 0.9)
    with pytest.raises(R.NoRuns):
        R.best_run(runs, "absent", "f1")
    cards = spark.createDataFrame([("m", "0.61", "old"), ("n", "7", None)], "model_name string, decision_threshold string, promoted_run_id string")
    promoted = R.promote(cards, "m", "r2")
    assert {r["model_name"]: r["promoted_run_id"] for r in promoted.collect()} == {"m": "r2", "n": None}
    assert promoted.where("model_name = 'm'").first()["promoted_at"].endswith("Z")
    write_cards(promoted, str(tmp_path / "c"))
    (tmp_path / "c" / "bad.json").write_text("{oops")
    got = {r["model_name"]: r["threshold"] for r in read_cards(spark, str(tmp_path / "c"), multi_line=False).collect()}
    assert got == {"m": 0.61, "n": 0.5}
    status = {r["model_name"]: (r["ready"], r["active"]) for r in R.model_status(promoted, ["m", "x"], "m").collect()}
    assert status == {"m": (True, True), "x": (False, False)}
    with pytest.raises(ValueError):
        R.switch_model("zzz", ["m"])


def test_search_measures_all_held_out_rows_and_keeps_rare_classes(data):
    """A sample bounds only the training sides, with the class shares of the whole."""
    sides, checked = [], []

    class Model:
        def transform(self, rows):
            checked.append(rows.count())
            return rows.withColumn("prediction", F.col("y").cast("double"))

    def fit(rows, params):
        sides.append({r["y"]: r["count"] for r in rows.groupBy("y").count().collect()})
        return Model()

    rows = data.drop("is_test")
    M.search(rows, fit, [{}], "y", "id", folds=2, rows=46)
    assert sum(checked) == 460 and sides == [{0: 40, 1: 6}] * 2


def test_registered_searches_see_the_whole_training_set(spark, monkeypatch):
    from faultlens.queries import models

    table = spark.range(3000).select(
        F.col("id").alias("event_id"), (F.col("id") % 60 == 0).cast("int").alias("y"), (F.col("id") % 5 == 0).alias("is_test"),
        *[F.lit(0.0).alias(c) for c in models.feature_names(False)],
    )
    monkeypatch.setattr(models, "modelled", lambda *a, **k: table)
    seen = []

    def search(df, *args, rows=None, **kwargs):
        seen.append((df.count(), rows))
        raise InterruptedError

    monkeypatch.setattr(models.M, "search", search)
    monkeypatch.setattr(models.M, "halving_search", search)
    for run in (models.forest_grid_search, models.boosted_scores):
        with pytest.raises(InterruptedError):
            run(spark, "")
    assert seen == [(2400, None), (2400, M.SEARCH_ROWS)]


def test_halving_ends_with_the_best_of_many(spark):
    """Candidates fall by a third a generation while their rounds grow, and none gets more than it was drawn with."""
    rows = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("y"))
    asked = []

    class Model:
        def __init__(self, quality, rounds):
            self.right = quality * min(rounds, 12)

        def transform(self, df):
            wrong = F.pmod(F.xxhash64("i"), F.lit(100)) >= self.right
            return df.withColumn("prediction", F.when(wrong, 1 - F.col("y")).otherwise(F.col("y")).cast("double"))

    def fit(train, params):
        asked.append((params["q"], params["maxIter"]))
        return Model(params["q"], params["maxIter"])

    candidates = [{"q": q, "maxIter": 10 if q == 7 else 100} for q in range(1, 10)]
    best = M.halving_search(rows, fit, candidates, "y", "i", first=4, factor=3)
    assert [t.params["q"] for t in best] == [9, 8, 7] and best[0].params["maxIter"] == 100
    assert sorted(set(asked)) == sorted({(q, 4) for q in range(1, 10)} | {(9, 12), (8, 12), (7, 10)})


@pytest.mark.parametrize("kind", ["stats", "patches", "flat"])
def test_windows_are_reduced_once_for_all_folds(spark, monkeypatch, kind):
    """Prepared windows give the scaler and the features that standardised ones give; no fold goes back to the windows."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, i % 3, [[float(a), float(b) + 900 * (i % 2), 4.0] for a, b in rng.normal(100, 20, (60, 2))]) for i in range(36)]
    windows = spark.createDataFrame(rows, "wid bigint, y int, fold int, x array<array<double>>").withColumn("near", F.array("fold"))
    fit, calls, raw = X.window_forest(3, kind, numTrees=3, maxDepth=3), [], X.window_features
    mean, std = window_scaler(windows, 3)
    got_mean, got_std = fit._scaler(fit.prepare(windows))
    assert np.allclose(got_mean, mean) and np.allclose(got_std, std)
    seen = []
    monkeypatch.setattr(X, "array_to_vector", lambda c: seen.append(c) or array_to_vector(c))
    fit(windows)
    got = np.array(fit.prepare(windows).orderBy("wid").select(seen[0].alias("f")).toPandas()["f"].tolist())
    want = windows.orderBy("wid").withColumn("z", standardize_window("x", mean, std)).select(M.window_features("z", 3, kind).alias("f")).toPandas()["f"]
    assert np.allclose(got, np.array(want.tolist()), atol=1e-6)
    monkeypatch.setattr(X, "window_features", lambda *a, **kw: calls.append(a) or raw(*a, **kw))
    scored = X.score_folds(windows, X.window_forest(3, kind, numTrees=3, maxDepth=3), 3)
    assert scored.count() == 36 and len(calls) == 1
    assert scored.where((F.col("score") >= 0.5) != (F.col("y") == 1)).isEmpty()


def test_net_gradient_and_layout_are_those_of_spark(spark, data, monkeypatch):
    """The gradient follows the loss, the model handed back is Spark's own with these weights, and no pass of Spark's optimiser reads the rows."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from faultlens.operators import nets

    layers, r = [4, 5, 3, 2], np.random.default_rng(1)
    w = nets.first_weights(layers, 7).astype("f8")
    x, y = r.normal(size=(20, 4)), r.integers(0, 2, 20)
    _, g = nets.gradient(x, y, w, layers)
    for i in (0, 19, 20, 24, 30, len(w) - 1):
        step = np.zeros(len(w))
        step[i] = 1e-6
        slope = (nets.gradient(x, y, w + step, layers)[0] - nets.gradient(x, y, w - step, layers)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-3 * max(1, abs(slope)) + 1e-5

    fitted = []
    monkeypatch.setattr(M, "fit_weights", lambda rows, shape, *a: fitted.append(rows.count()) or nets.first_weights(shape, 7))
    seen, fit = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    model = M.train_mlp(data, NAMES, hidden=[5, 3])
    assert fitted == [460] and seen == [1]
    rows = M.score(model, data, [*NAMES, "y"], 9).toPandas()
    out = rows[NAMES].to_numpy()
    for k, (a, b) in enumerate(net := nets.unrolled(w, layers)):
        out = out @ a + b
        out = 1 / (1 + np.exp(-out)) if k < len(net) - 1 else np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
    assert np.allclose(out[:, 1], rows["score"], atol=1e-5)


def test_reconstruction_thresholds_come_from_unseen_windows(spark):
    """With far more values than windows, errors of fitted windows are too low a threshold; models by moments are those fitted window by window."""
    r = np.random.default_rng(5)
    rows = [(i, int(i % 6 == 5), i // 12, (r.normal(50, 9, (30, 2)) + [[300.0 * (i % 6 == 5), 0.0]]).tolist()) for i in range(60)]
    windows = spark.createDataFrame(rows, "wid bigint, y int, fold int, x array<array<double>>").withColumn("x", F.transform("x", lambda v: F.concat(v, F.array(F.lit(7.25)))))
    placed = windows.withColumn("near", F.array("fold"))
    scored = X.score_folds(placed, X.window_reconstruction(3, 4), 5).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    assert scored.count() == 60 and f1_gate(scored).first()["f1"] > 0.8
    model = M.train_reconstruction(windows, 3, k=4)
    fit = X.window_reconstruction(3, 4)
    healthy = fit.prepare(placed.where("y = 0")).select(F.lit("0").alias("near"), "_flat")
    shift = np.tile([50.0, 40.0, 7.25], 30)
    (moments,) = fit._moments(healthy, shift).values()
    mean, std, centre, parts = fit._model([moments])
    assert moments[0] == 50 and np.allclose((mean + shift)[:3], model.channel_mean) and std[2] == 1.0
    assert np.allclose(centre, model.centre, atol=1e-8) and np.allclose(parts @ parts.T, model.components @ model.components.T, atol=1e-6)
