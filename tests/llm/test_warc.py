"""WARC archives: exact round trips, what other readers need to find, and revisits by hand."""

import hashlib
import random
from base64 import b32encode

import duckdb
import pytest
import zstandard

from conftest import SMALL
from faultlens.llm import common, sql, warc
from faultlens.llm.queries import QUERIES
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"


def odd_pages():
    rng = random.Random(4)
    many = [(100 + i, f"https://h{i % 3}.example/{i}", "<html><body>" + " ".join(rng.choice(["one", "two", "three", "<p>"]) for _ in range(200)) + "</body></html>") for i in range(80)]
    return many + [
        (5, "https://a.example/x", "<p>same</p>"), (3, "https://a.example/y\r\nX-Evil: 1", "<p>same</p>"), (None, None, "<p>same</p>"), (3, "https://a.example/y", "<p>same</p>"),
        (7, None, None), (8, "https://b.example/", ""), (9, "https://b.example/a b", "é😀\x00\r\n\r\nP*M\x18\x00\x00\x00\x00 WARC/1.1\r\n"), (None, None, None),
        (10, "https://b.example/long", "0123456789" * 50_000), (11, "https://b.example/", "(µ/ý"),
    ]


def by_hand(rows, least=0):
    first = {}
    for page, _, html in rows:
        first.setdefault(html or "", []).append((page is None, page or 0))
    out, used = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and html in used if html else len(data) >= least and "" in used
        used.add(html or "")
        none, best = min(first[html or ""])
        out.append((page, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again and not none else None))
    return sorted(out, key=repr)


FOUND = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def found(df):
    return sorted((tuple(r[c] for c in FOUND) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = common.shared_folder(spark, "test")
    warc.write_archives(pages, path, least_bytes=least, most_rows=16)
    read = warc.read_archives(spark, path, payload=True).collect()
    assert found(warc.read_archives(spark, path)) == by_hand(rows, least)
    texts = sorted((h or "").encode() for *_, h in rows)
    kept = [r.payload for r in read if r.record_type == "response"]
    assert set(map(bytes, kept)) == set(texts)
    assert len({r.record_id for r in read}) == len(rows)
    urls = {r.page_id: r.url for r in read if r.page_id is not None}
    assert urls[9] == "https://b.example/a%20b" and urls[7] is None


def test_archives_are_plain_zstandard(spark):
    """Each file starts with the dictionary its frames need; a reader that skips frames finds all records at their places."""
    rows = [(i, f"https://h.example/{i}", f"<html><head><title>page {i}</title></head><body>" + "<p>menu home about contact</p>" * 20 + str(i) * 50) for i in range(400)]
    path = common.shared_folder(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path, most_rows=64)
    files = {f.path: bytes(f.content) for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()}
    assert len(files) >= 6
    for r in warc.read_archives(spark, path).collect():
        data = files[r.archive]
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        own = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        assert own[:4] == b"\x37\xa4\x30\xec"
        text = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)).decompress(data[r.offset : r.offset + r.length])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and f"X-Page-Id: {r.page_id}\r\n".encode() in text
    # Nothing is left between frames but skippable ones.
    for data in files.values():
        assert sum(1 for _ in warc.frames(memoryview(data))) > 1


def test_bytes_close_an_archive(spark):
    rows = [(i, None, chr(97 + i % 26) * 3000) for i in range(60)]
    path = common.shared_folder(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, most_rows=1000, most_bytes=1)
    assert found(warc.read_archives(spark, path)) == by_hand(rows)


def test_damage_is_an_error():
    row = {"payload": b"abc", "sha1": None, "bytes": None, "file": "f", "row": 1, "digest": b"d", "own": True, "url": None, "page_id": 1, "refers_to": None}
    data = warc.page_record(row, warc.DATE)
    assert warc.read_record(data)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.read_record(data.replace(b"abc", b"abd"))


def test_hot_payload(spark):
    """A group with most of the rows is joined by broadcast, the others by a shuffle; none is lost."""
    rows = [(i, None, "hot") for i in range(500)] + [(1000 + i, None, f"pair {i // 2}") for i in range(2000)]
    assert found(warc.archive(spark.createDataFrame(rows, PAGES).repartition(4))) == by_hand(rows)


def test_empty_and_clashing(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
    names = ["key", "digest", "n", "best", "first", "payload", "sha1", "bytes", "file", "row", "own", "_hot_digest"]
    pages = spark.createDataFrame(odd_pages(), PAGES).withColumns({c: F.lit("mine") for c in names})
    assert found(warc.archive(pages)) == by_hand(odd_pages())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    got = QUERIES["op12_warc"](spark, SMALL)
    assert got.columns == FOUND
    want = con.execute(f"SELECT {', '.join(FOUND)} FROM ({sql.WARC})").fetchall()
    assert found(got) == sorted(want, key=repr)
