"""Helpers the operators share: words, row keys, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, even if the body reads it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read back.

    The copy survives lost executors, has no lineage and a known size.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, parts: int = 1000) -> DataFrame:
    """`rows` joined with the one row of `groups` per key, no task getting more than its share of a key.

    `size` is how many of `rows` a group has. Groups with over one in `parts` of all
    grouped rows are fewer than `parts`: they are broadcast. The rest is shuffled.
    """
    limit = (groups.agg(F.sum(size)).first()[0] or 0) / parts
    hot, rest = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    names = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    is_hot = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    cold = rows.join(F.broadcast(names), is_hot, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a column that tells rows apart, repeated rows included, and never changes; and its name.

    A plain Parquet scan has one for free: file and position in it. Any other
    frame is stored with running numbers first.
    """
    name = fresh(df, "_key")
    plain = df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    if plain and "_metadata" not in df.columns and df.inputFiles():
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))), name
    return stored(df.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))), name


def map_texts(docs: DataFrame, payload: Column, text: Column, columns: str, start: Callable[[], Callable]) -> DataFrame:
    """Rows (payload, *columns) made from texts in Arrow batches; NULL texts arrive as empty.

    `start()` runs once per task and gives `work(texts) -> (index, {column: values})`,
    where `index` names the text each row came from, or is None for one row per text.
    The payload, of any type, is passed on as it is.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(payload.alias("payload"), F.coalesce(text, F.lit("")).alias("text"))
    schema = StructType([rows.schema["payload"], *StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                index, made = work(part.column(1).to_pylist())
                own = part.column(0) if index is None else part.column(0).take(pa.array(index, pa.int64()))
                arrays = [own, *[v if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in list(arrow)[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return rows.mapInArrow(run, schema)
