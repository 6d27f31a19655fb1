"""Plain Python versions of what the operators compute, and awkward inputs for all of them."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977} x{i * 7 % 1009}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """NULLs in every column, empty, blank and very long texts, ties and repeated rows."""
    body = "the quick fox of the hill and a dog in the sun with some more words to say it well " * 4
    return [
        (1, body, "en", "a", 1),
        (1, body, "en", "a", 1),
        (2, body + "\n", "en", None, 1),
        (3, None, None, None, None),
        (None, body.upper(), "en", "b", 1),
        (None, None, None, "b", None),
        (4, "", "", "", 0),
        (5, " \t\n\x0b\x0c\r", "de", "a", 6),
        (6, LONG, "fr", "b", len(LONG)),
        (7, "one", "en", "c", 3),
        (8, "é😀 ünï    x", "en", "c", 5),
        (9, "\n".join(["a line that is long enough to count"] * 5 + ["Other text here"]), "en", "c", 9),
        (10, "  A LINE that is long enough to count \nx", "en", "c", 9),
        (11, "a line that is long enough to count", "en", "c", 9),
    ]


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def parquet(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def with_clashes(df):
    """Extra columns named like the operators' own."""
    names = ["_key", "n", "id", "payload", "kept", "run", "size", "cid", "n_words", "_kept", "_n", "copies", "base", "html"]
    return df.withColumns({c: F.lit("mine") for c in names if c not in df.columns})
