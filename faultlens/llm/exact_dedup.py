"""Exact dedup: runs of text digests, merged in rounds until one row stands for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import SPACE, keyed, stored, without

FAN_IN = 16


def digested(docs: DataFrame, payload: Column, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: payload, id, digest of the text without white space, and its run.

    Length and a second hash go with the digest, so texts count as equal only if
    all three agree. NULL counts as the empty text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    norm = without(t, SPACE)
    narrow = docs.select(
        payload.alias("payload"),
        F.col(id_).alias("id"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("proof"),
        F.length(norm).alias("norm_chars"),
        F.length(t).alias("chars"),
    )
    return stored(narrow.withColumns({"run": F.spark_partition_id(), "n": F.monotonically_increasing_id()}))


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The best row and the size of each group of equal texts.

    A round merges `fan_in` neighbouring runs into one. Within a run a text has one
    entry, so a group that holds a third of all rows is down to one entry per run
    before the first exchange, and every round is dealt by run and digest. The best
    row has the most characters, then the smallest id (NULL last), then came first.
    """
    text_key = ["digest", "proof", "norm_chars"]
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("n").alias("n"))
    runs = rows.agg(F.max("run")).first()[0]
    level = rows.select(*text_key, "run", best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    left = (runs or 0) + 1
    while True:
        left = -(-left // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *text_key)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        if left <= 1:
            return level.drop("run")


def dedup(docs: DataFrame, payload: Column, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: payload, id, keep_id, group_size, kept, digest.

    Exactly one row of a group is kept, also among repeated rows of one id. An
    empty table gives an empty result.
    """
    rows = digested(docs, payload, id_, text)
    groups = merge_runs(rows)
    return rows.join(groups, ["digest", "proof", "norm_chars"]).select(
        "payload",
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("n") == F.col("best.n")).alias("kept"),
        "digest",
    )


def keep_first(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    docs, key = keyed(docs)
    kept = dedup(docs, F.col(key), id_, text).where("kept").select(F.col("payload").alias(key))
    return docs.join(kept, key, "leftsemi").drop(key)
