"""The dealt operators over their whole tables, under the column contract of each query."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import alignment, collocations, exact_dedup, html, licenses, line_dedup, mixing, near_dedup, packing, pii, quality, secrets, sql, warc
from faultlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn

    return register


@query("op1_quality_rules", sql.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("own.doc_id", *[f"m.{n}" for n in names], "base_failed", "kept")


@query("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.col("doc_id"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select(F.col("payload").alias("doc_id"), "size", "source_size", "target", taken)


@query("op10_exact_dedup", sql.EXACT_DEDUP)
def exact_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup(table(spark, sf_dir, "documents"), F.col("doc_id"))
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return rows.select(F.col("payload").alias("doc_id"), "keep_id", "group_size", "kept", digest)


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), F.col("doc_id"), tokenizer).withColumnRenamed("payload", "doc_id")


@query("op9_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = secrets.scan(table(spark, sf_dir, "documents"), F.col("doc_id"), vocabulary, public_tokenizers.PATTERN)
    base = F.col("base")
    counts = [secrets.count(base, k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    everything = secrets.in_order(F.concat("base", "added"), secrets.KINDS)
    digest = F.sha2(secrets.joined(base), 256).alias("base_sha256")
    return found.select(F.col("payload").alias("doc_id"), *counts, digest, secrets.joined(everything).alias("spans"))


@query("op6_line_dedup", sql.LINE_DEDUP)
def line_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages"), F.struct("page_id", "url"))
    return texts.select("payload.page_id", "payload.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=4)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query("op4_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), F.col("doc_id"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.NAMES]
    digest = F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256")
    return found.select(F.col("payload").alias("doc_id"), *counts, digest, pii.joined(F.concat("base", "added")).alias("spans"))


@query("op7_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents count as files source/lang/shelf/doc_id, a hundred ids to a shelf."""
    shelf = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), shelf, F.col("doc_id").cast("string"))
    found = licenses.scan(table(spark, sf_dir, "documents"), path, F.col("doc_id"))
    return found.select(F.col("payload").alias("doc_id"), "path", "own_license", "cosine", "license", "from_dir")


@query("op11_phrase_collocations", sql.COLLOCATIONS)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op12_warc", sql.WARC)
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, model = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.align(table(spark, sf_dir, "documents"), F.col("doc_id"), ranks, public_tokenizers.PATTERN, model, digest=True)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.select(F.col("payload").alias("doc_id"), *numbers, F.col("groups").alias("groups_sha256"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
