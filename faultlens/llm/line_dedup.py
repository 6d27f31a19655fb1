"""Line dedup: two Bloom filters find suspected repeats; only those are shuffled and confirmed."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import SPACE, keyed, map_texts, stored

LEAST_CHARS = 20
LEAST_DOCS = 3
# Bits per line of a filter, and the most bits it may have (16 MB). A fuller filter only
# suspects more lines; what is dropped does not change.
BITS_PER_LINE = 16
MOST_BITS = 1 << 27
CHUNK_BITS = 1 << 16
FAN_IN = 32


def line_keys(text: str, least: int) -> list[bytes | None]:
    """The key of each line, or None where it is too short to be dropped."""
    out = []
    for line in text.split("\n"):
        line = line.strip(SPACE)
        out.append(line.encode("utf-8", "surrogatepass").lower() if len(line) >= least else None)
    return out


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions per 128-bit digest (rows of two uint64)."""
    return np.concatenate([digests[:, 0], digests[:, 1]]) & np.uint64(bits - 1)


def digest_lines(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Digests (two uint64 each), text and line number of all lines that are long enough, and lines per text."""
    data, owner, number, lines = [], [], [], []
    for i, text in enumerate(texts):
        keys = line_keys(text, least)
        lines.append(len(keys))
        for j, k in enumerate(keys):
            if k is not None:
                data.append(xxhash.xxh3_128_digest(k))
                owner.append(i)
                number.append(j)
    digests = np.frombuffer(b"".join(data), "<u8").reshape(-1, 2)
    return digests, np.array(owner, "int64"), np.array(number, "int64"), lines


def seen(docs: DataFrame, text: str, bits: int, least: int) -> DataFrame:
    """(chunk, task, once, twice): the set bits of each task's two filters, deflated, by chunk."""

    def run(batches):
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                digests, owner, _, _ = digest_lines(batch.slice(at, 512).column(0).to_pylist(), least)
                if not len(digests):
                    continue
                # A line counts once per document.
                rows = np.unique(np.column_stack([owner.astype("u8"), digests]), axis=0)
                distinct, counts = np.unique(rows[:, 1:], axis=0, return_counts=True)
                known = once[places(distinct, bits)].reshape(2, -1).all(axis=0)
                twice[places(distinct[known | (counts > 1)], bits)] = True
                once[places(distinct, bits)] = True
        task = TaskContext.get().partitionId()
        size = min(bits, CHUNK_BITS)
        chunks = np.flatnonzero(once.reshape(-1, size).any(axis=1))
        pack = lambda a, c: zlib.compress(np.packbits(a[c * size : (c + 1) * size]).tobytes(), 1)
        for k in range(0, len(chunks), 64):
            part = chunks[k : k + 64].tolist()
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array(part, pa.int32()), "run": pa.array([task] * len(part), pa.int32()), "once": [pack(once, c) for c in part], "twice": [pack(twice, c) for c in part]}
            )

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "chunk int, run int, once binary, twice binary")


def merge_filters(parts: DataFrame) -> DataFrame:
    """One pair of filters per chunk. A bit set once in two parts is set twice in the whole."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        once = twice = None
        for a, b in zip(g["once"], g["twice"]):
            a, b = (np.frombuffer(zlib.decompress(x), "u1") for x in (a, b))
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pd.DataFrame({"chunk": [g["chunk"].iloc[0]], "run": [g["run"].iloc[0]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    level = stored(parts)
    left = (level.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        level = level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
        level = stored(level.groupBy("chunk", "run").applyInPandas(merge, level.schema))
    return level


def filter_bits(lines: int) -> int:
    bits = CHUNK_BITS
    while bits < min(BITS_PER_LINE * lines, MOST_BITS):
        bits *= 2
    return bits


def dedup_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text.

    Lines whose key (stripped, A-Z lower-cased, at least `least_chars` long) is found
    in `least_docs` rows lose all copies but those in the rows of the largest id that
    holds it; a NULL id is less than any. A NULL or empty text is one empty line.
    Rows of one id count as documents of their own. An empty table gives an empty result.

    The first filter holds lines seen once, the second those seen again; merged over
    tasks they have no false negatives. Only lines in the second filter go through
    the shuffle that counts them exactly, by a 128-bit digest.
    """
    spark = docs.sparkSession
    docs, key = keyed(docs)
    docs = docs.select(F.col(key).alias("_key"), F.col(id_).alias("id"), F.col(text).alias("text"))
    lines = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))).first()[0] or 0
    bits = filter_bits(lines)
    merged = merge_filters(seen(docs, "text", bits, least_chars))
    # At most MOST_BITS bits, deflated: the one bounded thing that goes by the driver.
    chunks = spark.sparkContext.broadcast({r["chunk"]: r["twice"] for r in merged.select("chunk", "twice").collect()})

    def start() -> Callable:
        size = min(bits, CHUNK_BITS) // 8
        twice = np.zeros(bits // 8, "u1")
        for c, data in chunks.value.items():
            twice[c * size : (c + 1) * size] = np.frombuffer(zlib.decompress(data), "u1")

        def probe(texts: list[str]) -> tuple[None, dict]:
            digests, owner, number, n_lines = digest_lines(texts, least_chars)
            at = places(digests, bits)
            hit = (twice[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype("u1")) & 1
            hit = np.flatnonzero(hit.reshape(2, -1).all(axis=0))
            suspects: list[list[dict] | None] = [None] * len(texts)
            for i, j, (a, b) in zip(owner[hit].tolist(), number[hit].tolist(), digests[hit].view("<i8").tolist()):
                suspects[i] = suspects[i] or []
                suspects[i].append({"line": j, "a": a, "b": b})
            return None, {"n_lines": n_lines, "text": texts, "suspects": suspects}

        return probe

    columns = "n_lines long, text string, suspects array<struct<line:int,a:long,b:long>>"
    probed = map_texts(docs, F.struct("_key", "id"), F.col("text"), columns, start).select("payload.*", "n_lines", "text", "suspects")
    clean = probed.where("suspects IS NULL").select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))

    suspected = stored(probed.where("suspects IS NOT NULL"))
    found = suspected.select("_key", "id", F.explode("suspects").alias("s")).select("_key", "id", "s.*")
    per_doc = suspected.select("id", F.explode(F.array_distinct(F.transform("suspects", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))).alias("s"))
    counts = per_doc.groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keep"))
    repeats = counts.where(F.col("docs") >= least_docs).drop("docs")
    gone = found.join(repeats, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("keep")))
    drops = gone.groupBy("_key").agg(F.collect_list("line").alias("drop"))
    rest = suspected.select("_key", "id", "n_lines", "text").join(drops, "_key", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    kept = map_texts(rest, F.struct("id", "n_lines", "drop"), F.concat_ws("\n", F.array_join("drop", ","), "text"), "kept_text string", _drop)
    dirty = kept.select("payload.id", "payload.n_lines", F.size("payload.drop").cast("long").alias("n_dropped"), "kept_text")
    return clean.unionByName(dirty)


def _drop() -> Callable:
    """Texts arrive with the numbers of the lines to drop as their first line."""

    def drop(texts: list[str]) -> tuple[None, dict]:
        out = []
        for text in texts:
            gone, text = text.split("\n", 1)
            gone = set(map(int, gone.split(","))) if gone else ()
            out.append("\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone))
        return None, {"kept_text": out}

    return drop
