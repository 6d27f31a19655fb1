"""Runs, champion models and which model is active."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NoRuns(ValueError):
    """The experiment does not exist or has no runs."""


def best_run(runs: DataFrame, experiment: str, metric: str) -> DataFrame:
    """The run with the highest metric; runs without it come last, ties by run id."""
    best = (
        runs.where(F.col("experiment") == experiment)
        .select("run_id", F.try_element_at("metrics", F.lit(metric)).alias("value"))
        .orderBy(F.desc_nulls_last("value"), "run_id")
        .limit(1)
    )
    if best.isEmpty():
        raise NoRuns(f"no runs found for experiment {experiment!r}")
    return best


def promote(cards: DataFrame, model: str, run_id: str, at: Column | None = None) -> DataFrame:
    """Cards with the promoted run written into the card of `model`; others unchanged."""
    chosen = F.col("model_name") == model
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if at is None else at
    old = {c: F.col(c) if c in cards.columns else F.lit(None).cast("string") for c in ("promoted_run_id", "promoted_at")}
    return cards.withColumns(
        {
            "promoted_run_id": F.when(chosen, F.lit(run_id)).otherwise(old["promoted_run_id"]),
            "promoted_at": F.when(chosen, at).otherwise(old["promoted_at"]),
        }
    )


def model_status(cards: DataFrame, known: Sequence[str], active: str | None) -> DataFrame:
    """Every known model, whether its card exists, and whether it is the active one."""
    spark = cards.sparkSession
    names = spark.createDataFrame([(n,) for n in sorted(known)], "model_name string")
    have = cards.select("model_name").distinct().withColumn("_have", F.lit(True))
    return names.join(have, "model_name", "left").select(
        "model_name",
        F.coalesce("_have", F.lit(False)).alias("ready"),
        F.coalesce(F.col("model_name") == F.lit(active), F.lit(False)).alias("active"),
    )


def switch_model(name: str, known: Sequence[str]) -> str:
    """The normalised name of a known model; anything else is rejected."""
    cleaned = name.strip().lower()
    if cleaned not in known:
        raise ValueError(f"unknown model {name!r}; known: {sorted(known)}")
    return cleaned
