"""Fold-wise fits: each fold gets a scaler and a model of its own, and no window it has seen a row of."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.scalar import anomaly_score
from faultlens.operators.evaluate import GATE_F1, cv_summary, error_threshold, f1_gate, fold_metrics
from faultlens.operators.sampling import group_folds, stratified_folds
from faultlens.operators.training import SEED, score, weight_column, window_features
from faultlens.operators.windows import channel, fold_of_window, windows_by_day
from faultlens.session import cut

# A fit takes the training windows and gives a function that adds `score` to others.
Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Scorer]
FITS_AT_ONCE = 4
SCHEMES = ("stratified", "by_day")


def with_near_folds(folds: DataFrame, wid: str, reach: int) -> DataFrame:
    """Adds `near`: the folds of all windows at most `reach` numbers away, which share rows with this one."""
    around = folds.select(F.col("fold").alias("_f"), F.explode(F.sequence(F.col(wid) - reach, F.col(wid) + reach)).alias(wid))
    near = around.groupBy(wid).agg(F.collect_set("_f").alias("near"))
    return folds.join(near, wid)


def place(windows: DataFrame, scheme: str, k: int, reach: int, wid: str = "wid", y: str = "y") -> DataFrame:
    """The windows with `fold` and `near`.

    `stratified` deals single windows, so a fold trains on windows that overlap those it
    is measured on; nothing is purged. `by_day` keeps the days of windows' first rows whole,
    and a window that reaches into a day of another fold is left out of that fold's training.
    """
    if scheme == "stratified":
        return stratified_folds(windows, y, wid, k).withColumn("near", F.array("fold"))
    if scheme != "by_day":
        raise ValueError(f"unknown scheme {scheme!r}; choose from {SCHEMES}")
    placed = fold_of_window(windows_by_day(windows, drop_cross_day=False), group_folds(windows_by_day(windows, drop_cross_day=False), "day", k).select("day", "fold"))
    near = with_near_folds(placed.select(wid, "fold"), wid, reach).drop("fold")
    return placed.join(near, wid)


def score_folds(placed: DataFrame, fit: Fit, k: int, wid: str = "wid", y: str = "y") -> DataFrame:
    """(wid, y, fold, score): each window scored by the model of its fold, a few folds being fitted at once.

    What a fit has to do to windows whatever the fold, its `prepare` does once; one that can fit all
    folds together has a `score_folds` of its own.
    """
    if hasattr(fit, "score_folds"):
        return cut(fit.score_folds(placed, k, wid))
    if hasattr(fit, "prepare"):
        placed = fit.prepare(placed)

    def run(fold: int) -> DataFrame:
        train = placed.where((F.col("fold") != fold) & ~F.array_contains("near", fold))
        return fit(train)(placed.where(F.col("fold") == fold)).select(wid, y, "fold", "score")

    with ThreadPool(FITS_AT_ONCE) as pool:
        parts = pool.map(run, range(k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut(out)


def prepared(windows: DataFrame, fit: Fit) -> DataFrame:
    """The windows as `fit` reads them in every fold, stored once."""
    return fit.prepare(windows) if hasattr(fit, "prepare") else cut(windows)


def fold_table(placed: DataFrame, scored: DataFrame, k: int, y: str = "y") -> DataFrame:
    """`fold_metrics` of the scores, with the windows and class weight each fold was really trained on."""
    own = placed.select(y, F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: ~F.array_contains("near", f) & (f != F.col("fold")))).alias("fold"))
    pos = F.sum(F.col(y).cast("long"))
    sizes = own.groupBy("fold").agg(F.count("*").alias("n_train"), F.round((F.count("*") - pos) / F.greatest(F.lit(1), pos), 4).alias("pos_weight"))
    return fold_metrics(scored).drop("n_train", "pos_weight").join(sizes, "fold")


def evaluate(windows: DataFrame, fit: Fit, k: int = 5, reach: int = 5, gate: float = GATE_F1) -> tuple[DataFrame, DataFrame]:
    """One row per scheme and fold, and the mean and deviation of the metrics per scheme.

    `passed` tells whether F1 over all windows of a scheme, each scored by the fold that
    had not seen it, reaches the gate.
    """
    tables, summaries = [], []
    windows = prepared(windows, fit)
    for scheme in SCHEMES:
        placed = cut(place(windows, scheme, k, reach))
        scored = score_folds(placed, fit, k)
        passed = f1_gate(scored.withColumn("pred", (F.col("score") >= 0.5).cast("int")), gate=gate).first()["passed"]
        table = cut(fold_table(placed, scored, k))
        tables.append(table.select(F.lit(scheme).alias("scheme"), "*", F.lit(passed).alias("passed")))
        summaries.append(cv_summary(table, ["f1_default", "roc_auc", "f1_tuned"]).select(F.lit(scheme).alias("scheme"), "*"))
    return tables[0].unionByName(tables[1]), summaries[0].unionByName(summaries[1])


@dataclass(frozen=True)
class WindowForest:
    """A forest over window vectors; the channel scaler is fitted on the training windows.

    `prepare` reduces each window once to its raw features and the moments of its channels.
    Standardising is affine, so every fold then works on these few numbers.
    """

    channels: int
    kind: str
    x: str
    y: str
    seed: int
    params: dict

    def prepare(self, windows: DataFrame) -> DataFrame:
        if "_raw" in windows.columns:
            return windows
        c = range(self.channels)
        parts = [channel(self.x, i) for i in c]

        def spread(v: Column, m: Column) -> Column:
            return F.aggregate(v, F.lit(0.0), lambda s, a: s + (a - m) * (a - m))

        sums = windows.withColumn("_sums", F.array(*[F.aggregate(v, F.lit(0.0), lambda s, a: s + a) for v in parts])).withColumn("_n", F.size(self.x))
        own = [F.get("_sums", F.lit(i)) / F.col("_n") for i in c]
        spreads = F.array(*[spread(v, m) for v, m in zip(parts, own)])
        return cut(sums.withColumns({"_spreads": spreads, "_raw": window_features(self.x, self.channels, self.kind)}).drop(self.x))

    def __call__(self, train: DataFrame) -> Scorer:
        if "_raw" not in train.columns:
            inner = self(self.prepare(train))
            return lambda df: inner(self.prepare(df))
        mean, std = self._scaler(train)
        # Of each feature what is taken off and what it is divided by.
        places = range(5 * self.channels) if self.kind == "stats" else range(self.channels)
        of = [i // 5 for i in places] if self.kind == "stats" else list(places)
        off = [0.0 if self.kind == "stats" and i % 5 in (1, 4) else mean[c] for i, c in zip(places, of)]
        rule = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(std[c] or 1.0)).alias("s")) for m, c in zip(off, of)])

        def scaled(df: DataFrame) -> DataFrame:
            values = F.transform("_raw", lambda v, i: (v - F.get(rule, i % len(of))["m"]) / F.get(rule, i % len(of))["s"])
            return df.withColumn("features", array_to_vector(values))

        forest = RandomForestClassifier(labelCol=self.y, weightCol="weight", seed=self.seed, **self.params)
        model = Pipeline(stages=[forest]).fit(weight_column(scaled(train), self.y))
        return lambda df: score(model, scaled(df), ["wid", self.y, "fold"])

    def _scaler(self, train: DataFrame) -> tuple[list[float], list[float]]:
        """What `window_scaler` gives, from the moments of the windows."""
        c = range(self.channels)
        row = train.agg(F.sum("_n").alias("n"), *[F.sum(F.get("_sums", F.lit(i))).alias(f"c{i}") for i in c]).first()
        if not row["n"]:
            raise ValueError("no windows to fit the scaler on")
        mean = [row[f"c{i}"] / row["n"] for i in c]

        def spread(i: int) -> Column:
            gap = F.get("_sums", F.lit(i)) / F.col("_n") - mean[i]
            return F.sum(F.get("_spreads", F.lit(i)) + F.col("_n") * gap * gap).alias(f"c{i}")

        found = train.agg(*[spread(i) for i in c]).first()
        return mean, [(found[f"c{i}"] / row["n"]) ** 0.5 for i in c]


def window_forest(channels: int, kind: str = "stats", x: str = "x", y: str = "y", seed: int = SEED, **params) -> Fit:
    return WindowForest(channels, kind, x, y, seed, params)


@dataclass(frozen=True)
class WindowReconstruction:
    """Principal components of healthy windows; the score is the error against its threshold.

    The threshold is the 99th percentile of the errors of healthy windows by components that were not
    fitted on them, as errors of fitted ones are too low: each training fold is measured by a model of
    the other training folds. `prepare` makes a window one flat array. Standardising is affine, so
    scalers, centres and components of all these models follow from the sums and products of the raw
    values per `near`, gathered in one pass; a second one takes all errors.
    """

    channels: int
    components: int
    percentile: float = 99.0
    x: str = "x"
    y: str = "y"

    def prepare(self, windows: DataFrame) -> DataFrame:
        return windows if "_flat" in windows.columns else cut(windows.withColumn("_flat", F.flatten(self.x)).drop(self.x))

    def score_folds(self, placed: DataFrame, k: int, wid: str = "wid") -> DataFrame:
        placed = self.prepare(placed)
        # Products of differences from one healthy row: a channel without spread stays exactly 0.
        healthy = placed.where((F.col(self.y) == 0) & F.col("_flat").isNotNull())
        one = healthy.select(F.slice("_flat", 1, self.channels).alias("v"), F.size("_flat").alias("n")).first()
        if one is None:
            raise ValueError("no windows to fit the scaler on")
        size = one["n"]
        shift = np.tile(np.array(one["v"], "f8"), size // self.channels)
        near = F.concat_ws(",", F.transform(F.array_sort("near"), lambda f: f.cast("string")))
        moments = self._moments(healthy.select(near.alias("near"), "_flat"), shift)
        # For each two folds the model that has seen neither; for one fold (twice) the one it is scored by.
        models = {(f, v): self._model([m for g, m in moments.items() if not {f, v} & g]) for f in range(k) for v in range(f, k)}
        if any(models[f, f] is None for f in range(k)):
            raise ValueError("no windows to fit the scaler on")
        # Too few folds with healthy windows: errors of windows that the model has seen are all there is.
        models = {(f, v): m or models[f, f] for (f, v), m in models.items()}
        shared = placed.sparkSession.sparkContext.broadcast(models)

        @F.pandas_udf("array<double>")
        def errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for flat, fold in batches:
                rows, at = np.stack(flat.to_numpy()).astype("f8") - shift, fold.to_numpy()
                out = np.empty((len(rows), k))
                for v in np.unique(at):
                    here = at == v
                    for f in range(k):
                        mean, std, centre, parts = shared.value[min(f, v), max(f, v)]
                        z = (rows[here] - mean) / std - centre
                        lost = z - (z @ parts) @ parts.T
                        out[here, f] = (lost * lost).mean(axis=1)
                yield pd.Series(list(out))

        scored = cut(placed.select(wid, self.y, "fold", "near", errors("_flat", "fold").alias("errors")))
        score = F.lit(None).cast("double")
        for f in range(k):
            unseen = scored.where(~F.array_contains("near", f) & (F.col("fold") != f)).withColumn("error", F.get("errors", F.lit(f)))
            limit = error_threshold(unseen, "error", self.y, self.percentile)
            score = F.when(F.col("fold") == f, anomaly_score(F.get("errors", F.lit(f)), limit)).otherwise(score)
        return scored.select(wid, self.y, "fold", score.alias("score"))

    def _moments(self, healthy: DataFrame, shift: np.ndarray) -> dict[frozenset, tuple[int, np.ndarray, np.ndarray]]:
        """Per set of near folds: count, sums and products of the shifted values.

        A matrix of products is 720 by 720 for 60 readings of 12 channels, whatever the number of windows.
        """
        size = len(shift)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                groups = np.array(batch.column(0).to_pylist())
                rows = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) - shift if batch.num_rows else np.empty((0, size))
                rows = np.hstack([np.ones((len(rows), 1)), rows])
                for g in set(groups):
                    own = rows[groups == g]
                    held[g] = held.get(g, 0) + own.T @ own
            for g, total in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * (size + 1)), pa.array(range(size + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=names)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for g, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)):
                    held[g, i] = held.get((g, i), 0) + row
            if held:
                g, i = zip(*held)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(i, pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=names)

        names, shape = ["near", "i", "row"], "near string, i int, row array<double>"
        sums = cut(healthy.mapInArrow(add, shape).repartition("near", "i").mapInArrow(join, shape))
        out = {}
        for g in [r[0] for r in sums.select("near").distinct().collect()]:  # at most a few sets of neighbouring folds
            rows = {r["i"]: np.array(r["row"]) for r in sums.where(F.col("near") == g).collect()}
            total = np.stack([rows[i] for i in range(size + 1)])
            out[frozenset(map(int, g.split(",")))] = (int(round(total[0, 0])), total[0, 1:], total[1:, 1:])
        return out

    def _model(self, moments: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple | None:
        """(mean, deviation, centre, components) of shifted windows, the first two per flat value; None without windows."""
        n = sum(m[0] for m in moments)
        if not n:
            return None
        sums, products = sum(m[1] for m in moments), sum(m[2] for m in moments)
        c = self.channels
        times = len(sums) // c
        mean = sums.reshape(times, c).sum(axis=0) / (n * times)
        square = np.diag(products).reshape(times, c).sum(axis=0) / (n * times)
        std = np.sqrt(np.maximum(square - mean * mean, 0))
        mean, std = np.tile(mean, times), np.tile(np.where(std > 0, std, 1.0), times)
        own = sums / n
        spread = (products / n - np.outer(own, own)) / np.outer(std, std)
        _, vectors = np.linalg.eigh(spread)
        return mean, std, (own - mean) / std, np.ascontiguousarray(vectors[:, ::-1][:, : self.components])


def window_reconstruction(channels: int, components: int = 8) -> WindowReconstruction:
    return WindowReconstruction(channels, components)
