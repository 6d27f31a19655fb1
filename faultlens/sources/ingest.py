"""Raw sensor files in, labelled Parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators.labels import FAILURES, day_key, label_intervals
from faultlens.schema import RAW_SCHEMA, SENSORS, UNMODELLED, require_columns

MAX_ROWS_PER_FILE = 20_000_000


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """The contract columns of a CSV with header, typed without inference.

    Columns are matched by name: only the header line is read to learn the order,
    and columns beyond the contract are parsed as text and dropped by the scan. A file
    whose header has another order is refused rather than read into wrong columns, and
    a cell that is no number or time fails the read rather than become NULL.
    """
    header = spark.read.option("header", True).csv(path)
    require_columns(header, schema.fieldNames())
    kinds = {f.name: f.dataType for f in schema.fields}
    layout = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header.columns])
    strict = spark.read.schema(layout).options(header=True, enforceSchema=False, mode="FAILFAST")
    return strict.csv(path).select(*schema.fieldNames())


def scan(spark: SparkSession, path: str, optional: Sequence[str] = ("timestamp", "anomaly")) -> DataFrame:
    """Sensors plus whichever of the optional columns the file has; pruned at the scan."""
    df = spark.read.parquet(path)
    require_columns(df, SENSORS)
    return df.select(*[c for c in optional if c in df.columns], *SENSORS)


def is_ingested(spark: SparkSession, path: str, label: str = "anomaly") -> bool:
    """True only if the output exists and already carries the label (schema read, no job)."""
    try:
        return label in spark.read.parquet(path).columns
    except AnalysisException:
        return False


def prepare(
    raw: DataFrame, intervals: Sequence[tuple[str, str]] = FAILURES, ts: str = "timestamp"
) -> DataFrame:
    """Check the contract, narrow sensors to FLOAT and label each row."""
    sensors = [c for c in SENSORS + UNMODELLED if c in raw.columns]
    require_columns(raw, [ts, *SENSORS])
    narrow = raw.withColumns({c: F.col(c).cast("float") for c in sensors})
    return label_intervals(narrow, intervals, ts)


def write_labelled(labelled: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Snappy Parquet by day, sorted by time inside each file.

    Range partitioning on (day, time) sorts the table without one giant task, and a
    day with very many rows is spread over several files.
    """
    keyed = labelled.withColumn("day", day_key(ts))
    (
        keyed.repartitionByRange("day", ts)
        .sortWithinPartitions("day", ts)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("day")
        .parquet(path)
    )


def ingest(
    spark: SparkSession,
    csv: str,
    out: str,
    intervals: Sequence[tuple[str, str]] = FAILURES,
    schema: T.StructType = RAW_SCHEMA,
) -> bool:
    """Run the ingestion unless it was done before; True if it wrote."""
    if is_ingested(spark, out):
        return False
    write_labelled(prepare(read_raw_csv(spark, csv, schema), intervals), out)
    return True
