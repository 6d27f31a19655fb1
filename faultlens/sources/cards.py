"""Model cards: one JSON document per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.scalar import resolve_threshold

CARD_SCHEMA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("decision_threshold", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_test", T.LongType()),
        T.StructField("promoted_run_id", T.StringType()),
        T.StructField("promoted_at", T.StringType()),
    ]
)
_CORRUPT = "_corrupt"


def write_cards(cards: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cards as JSON lines; there are as many rows as models."""
    cards.write.mode(mode).json(path)


def read_cards(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All readable cards of a folder with their usable threshold; malformed ones are left out."""
    schema = T.StructType([*CARD_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    docs = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )
    good = docs.where(F.col(_CORRUPT).isNull() & F.col("model_name").isNotNull()).drop(_CORRUPT)
    return good.withColumn("threshold", resolve_threshold("decision_threshold"))
