"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS configure it."""

from __future__ import annotations

import json
import os
import time

from faultlens.operators.features import add_features
from faultlens.queries import REGISTRY
from faultlens.queries.registry import sensors
from faultlens.schema import SENSORS
from faultlens.session import session

HEADLINE = [
    "labelled_risk_summary",
    "interval_label",
    "interval_label_range_join",
    "full_features",
    "impute_ffill_bfill",
    "halo_moving_average",
    "global_row_index",
    "sliding_windows",
    "window_patches",
    "asof_latest_prediction",
    "last_n_per_asset",
    "fbeta_threshold",
    "roc_auc",
    "fold_metrics",
    "iqr_outliers",
    "correlation_matrix",
    "histogram_60",
    "stratified_split",
    "knn_minority",
    "smote",
    "duty_cycle",
    "daily_alert_counts",
    "feed_quality",
    "stream_scored",
]
RATES = {
    "full_features": "events",
    "eighty_features": "events",
    "sliding_windows": "events",
    "interval_label": "events",
    "asof_latest_prediction": "events",
    "fbeta_threshold": "events",
    "smote": "embeddings",
}


def eighty_features(spark, sf_dir):
    """The feature operator alone; the registered query also rounds all 80 columns."""
    rows = sensors(spark, sf_dir).select("event_id", "ts", "asset_id", *SENSORS)
    return add_features(rows, "asset_id", gaps=False)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's file readers and the Python workers outside the timings.
    spark.read.parquet(f"{sf_dir}/nation.parquet").mapInPandas(lambda it: it, "n_nationkey int, n_name string, n_regionkey int").count()
    seconds = {}
    runs = {name: REGISTRY[name].run for name in HEADLINE} | {"eighty_features": eighty_features}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(RATES.values())}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {q: round(rows[t] / seconds[q]) for q, t in RATES.items()},
                "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
