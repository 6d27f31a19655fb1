"""The live path: buffer, features, score, history and alerts per micro-batch.

Each micro-batch joins the newest buffered readings of its assets with the arriving
ones and runs the batch feature code over both. The batch result is reproduced
exactly, an asset with a third of the readings is cut into cells like any long
series, and no reading passes through Python.

The buffers are kept in buckets by a hash of the asset. A batch reads and rewrites the
buckets that its assets fall in and leaves the others alone; a small table of versions
names the batch that wrote each bucket last, so a replayed batch finds the buffers as it
found them first. Outputs are committed one by one (`CommitLog`): if one fails, the
others still go out, and the replay does what is left only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.scalar import ALERT_THRESHOLD, DEFAULT_THRESHOLD, decide
from faultlens.operators.features import CROSS, FeatureSpec, build_features, validate_readings
from faultlens.operators.fleet import alert_rows
from faultlens.plans.series import lay_out
from faultlens.schema import SENSORS
from faultlens.session import cut
from faultlens.sources.sinks import read_batches, write_batch
from faultlens.streaming.commits import CommitLog, Folder

BUFFER, WARM = 30, 16
STATE_BUCKETS = 64

Scorer = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]


class LiveWriteError(RuntimeError):
    """Some outputs of a batch could not be written; the replay writes those."""


@dataclass
class LivePath:
    """State and outputs below `root`, a folder all executors share.

    `score` adds `probability` to a frame with the feature columns. It is called once
    per micro-batch, so it may look up the active model each time. Without it, or with
    `keep_features`, the feature columns themselves are kept. `sinks` replaces where an
    output (predictions, alerts, quarantine, late) goes.
    """

    root: str
    score: Scorer | None = None
    key: str = "asset_id"
    order: Sequence[str] = ("ts", "event_id")
    sensors: Sequence[str] = tuple(SENSORS)
    spec: FeatureSpec = field(default_factory=FeatureSpec)
    buffer: int = BUFFER
    warm: int = WARM
    threshold: float = DEFAULT_THRESHOLD
    alert_above: float = ALERT_THRESHOLD
    keep_features: bool = False
    target_rows: int | None = None
    buckets: int = STATE_BUCKETS
    sinks: Mapping[str, Sink] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.buffer <= self.spec.lookback:
            raise ValueError(f"the buffer must hold more than {self.spec.lookback} readings")

    @property
    def _reach(self) -> int:
        """How many readings back a feature or the warm flag looks."""
        return max(self.spec.lookback, self.warm - 1)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def results(self, spark: SparkSession, name: str = "predictions") -> DataFrame:
        """One of predictions, alerts, quarantine, late."""
        return read_batches(spark, self.path(name))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, self.path("commits"), batch_id)
        names = ["quarantine", "late", "predictions", *(["alerts"] if self.score else [])]
        if log.has("state") and all(map(log.has, names)):
            return
        self._clean(spark, batch_id)
        outputs = self._outputs(batch, batch_id, log)
        failed: dict[str, Exception] = {}
        for name in names:
            if log.has(name):
                continue
            try:
                self._write(name, outputs[name], batch_id)
                log.put(name)
            except Exception as error:  # noqa: BLE001 - the other outputs must still go out
                failed[name] = error
        if failed:
            raise LiveWriteError(f"batch {batch_id}: {', '.join(failed)} not written") from next(iter(failed.values()))

    def _outputs(self, batch: DataFrame, batch_id: int, log: CommitLog) -> dict[str, DataFrame]:
        """The frames of all outputs. What is scored is stored once, so that a replay alerts and records the same."""
        columns = [self.key, *self.order, *self.sensors]
        # Read the source once: the batch feeds quarantine, late rows, state and features.
        checked = cut(validate_readings(batch.select(*columns)))
        fresh = checked.where("is_valid").select(*columns)
        # At most `buckets` numbers.
        touched = sorted(r[0] for r in fresh.select(self._bucket()).distinct().collect())
        state = self._read_state(fresh, batch_id, touched)
        newest = state.groupBy(self.key).agg(F.max(F.struct(*self.order)).alias("_newest"))
        placed = fresh.join(newest, self.key, "left")
        late = F.coalesce(F.struct(*self.order) <= F.col("_newest"), F.lit(False))
        fresh = placed.where(~late).drop("_newest")

        if not log.has("scored"):
            # Features look no further back than this; the rest of a buffer is not carried through them.
            near = state.where(F.coalesce(F.col("_n") <= self._reach, F.lit(True))).drop("_n")
            kept = near.join(fresh.select(self.key).distinct(), self.key, "left_semi")
            rows = fresh.withColumn("_fresh", F.lit(True)).unionByName(kept.withColumn("_fresh", F.lit(False)))
            scored = self._features(rows).where("_fresh").drop("_fresh")
            if self.score:
                scored = self.score(scored).withColumn("predicted_class", decide("probability", self.threshold))
                if not self.keep_features:
                    # The history holds the reading and its verdict; unused features are never computed.
                    scored = scored.select(*columns, "is_warm", "predicted_class", "probability")
            write_batch(scored, self.path("pending"), batch_id)
            log.put("scored")
        if not log.has("state"):
            self._write_state(fresh.unionByName(state.drop("_n")), batch_id, touched)
            log.put("state")
        scored = batch.sparkSession.read.parquet(f"{self.path('pending')}/batch={batch_id}")
        out = {"predictions": scored, "quarantine": checked.where("NOT is_valid").drop("is_valid"), "late": placed.where(late).drop("_newest")}
        if self.score:
            out["alerts"] = alert_rows(scored, self.alert_above, self.key, self.order[0])
        return out

    def _write(self, name: str, df: DataFrame, batch_id: int) -> None:
        if name in self.sinks:
            self.sinks[name](df, batch_id)
        else:
            write_batch(df, self.path(name), batch_id, self.order[0] if name == "predictions" else None)

    def _features(self, rows: DataFrame) -> DataFrame:
        """Rolling features once the asset is warm, snapshot features before."""

        def build(df, w, long):
            seen = F.row_number().over(w)
            return build_features(df.withColumn("is_warm", seen >= self.warm), w, long, self.spec)

        rolled = lay_out(rows, self.key, self.order, self.target_rows).roll(self._reach, build).rows
        added = [c for c in rolled.columns if c not in rows.columns and c != "is_warm"]
        return rolled.withColumns(
            {c: F.when(F.col("is_warm"), F.col(c)).otherwise(self._snapshot(c)) for c in added}
        )

    def _snapshot(self, name: str) -> Column:
        """The value a feature takes for a reading without history."""
        if name in CROSS:
            return F.col(name)  # needs no history
        for x in self.spec.sensors:
            if name in (f"{x}_ma_{self.spec.window_ma_short}", f"{x}_ma_{self.spec.window_ma_long}"):
                return F.col(x).cast("double")
        return F.lit(0.0)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _state(self, spark: SparkSession) -> Folder:
        return Folder(spark, self.path("state"))

    def _versions(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """Of each bucket the batch up to `batch_id` that wrote it last."""
        text = self._state(spark).read(f"versions/{batch_id}.json") if batch_id >= 0 else None
        return {int(k): v for k, v in json.loads(text).items()} if text else {}

    def _read_state(self, like: DataFrame, batch_id: int, touched: list[int]) -> DataFrame:
        """Buffered readings of the `touched` buckets, as the batch before this one left them; `_n` is 1 for an asset's newest."""
        spark = like.sparkSession
        versions = self._versions(spark, batch_id - 1)
        folders = [f"{self.path('state')}/batch={versions[k]}/bucket={k}" for k in touched if k in versions]
        if not folders:
            return like.limit(0).withColumn("_n", F.lit(None).cast("int"))
        return spark.read.schema(T.StructType(list(like.schema.fields)).add("_n", T.IntegerType())).parquet(*folders)

    def _write_state(self, rows: DataFrame, batch_id: int, touched: list[int]) -> None:
        """The newest `buffer` readings of each asset of the `touched` buckets, and the new table of versions."""
        spark = rows.sparkSession
        w = W.partitionBy(self.key).orderBy(*[F.desc(c) for c in self.order])
        newest = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= self.buffer)
        if touched:
            # A bucket's rows are gathered first, else each task would write a file for each bucket.
            newest.withColumn("bucket", self._bucket()).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path('state')}/batch={batch_id}")
        versions = self._versions(spark, batch_id - 1) | dict.fromkeys(touched, batch_id)
        self._state(spark).write(f"versions/{batch_id}.json", json.dumps(versions))

    def _clean(self, spark: SparkSession, batch_id: int) -> None:
        """Deletes what only the batch before, which is done, could have needed again."""
        folder = self._state(spark)
        old, new = self._versions(spark, batch_id - 2), self._versions(spark, batch_id - 1)
        for bucket, version in old.items():
            if new.get(bucket, version) != version:
                folder.delete(f"batch={version}/bucket={bucket}")
        folder.delete(f"versions/{batch_id - 3}.json")
        Folder(spark, self.path("pending")).delete(f"batch={batch_id - 1}")


def active_model_scorer(spark: SparkSession, table: str, models: dict[str, Scorer]) -> Scorer:
    """Looks up the active model's name per micro-batch, so it can change while running."""

    def score(df: DataFrame) -> DataFrame:
        row = spark.read.parquet(table).orderBy(F.desc("since")).select("model_name").first()
        if row is None or row["model_name"] not in models:
            raise ValueError("no known model is active")
        return models[row["model_name"]](df)

    return score


