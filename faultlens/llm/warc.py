"""WARC archives of pages: records compressed one by one with a dictionary of their own archive."""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.common import join_groups, keyed, shared_folder, stored
from faultlens.plans.bounded import small

# Rows of one archive (records, a dictionary, padding) and bytes of its records before compression.
RECORDS = 32_768
ARCHIVE_BYTES = 64 << 20
# The dictionary of an archive is built from its first records of this many bytes.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# Fixed values of the formats: frame magics of Zstandard, media types and the profile of a revisit.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SKIPPABLE = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
HTTP = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An empty skippable frame. All its bytes are ASCII, so it can stand between records as
# the line separator of Spark's text files: these are then valid Zstandard files.
GAP = "P*M\x18\x00\x00\x00\x00"
DATE = "1970-01-01T00:00:00Z"

COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, archive string, offset long, length long"


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def record_id(seed: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seed).digest()[:16], version=5)}>"


def escaped(url: str) -> str:
    """A URL fit for a header line: control characters are written as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """A response, or a revisit where `row` has no payload."""
    again, payload = row["payload"] is None, row["payload"] or b""
    digest = bytes.fromhex(row["sha1"]) if again else hashlib.sha1(payload).digest()
    size = row["bytes"] if again else len(payload)
    place = f"{row['file']}#{row['row']}".encode()
    first = record_id(row["digest"])
    fields = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": first if row["own"] and not again else record_id(row["digest"] + place),
        "WARC-Date": date,
        "WARC-Target-URI": None if row["url"] is None else escaped(row["url"]),
        "WARC-Payload-Digest": "sha1:" + base32(digest),
        "WARC-Profile": PROFILE if again else None,
        "WARC-Refers-To": first if again else None,
        "X-Page-Id": row["page_id"],
        "X-Refers-To-Page-Id": row["refers_to"],
        "Content-Type": HTTP,
    }
    return record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload)


def archive_info(date: str) -> bytes:
    about = b"format: WARC File Format 1.1\r\n"
    return record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(about), "WARC-Date": date, "Content-Type": "application/warc-fields"}, about)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from `records`, or None where they are too few to give one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8)
    except zstandard.ZstdError:
        return None


def archive_rows(records: Iterator[bytes], most_rows: int, most_bytes: int, info: bytes) -> Iterator[bytes | None]:
    """The rows of archives of `most_rows` rows each, one after the other: first the dictionary, then a frame per record.

    An archive that its bytes close early is filled up with empty rows, so that each
    archive begins at a multiple of `most_rows`.
    """
    left = next(records, None)
    while left is not None:
        size, sample = 0, [info]
        while left is not None and size < SAMPLE_BYTES and len(sample) < most_rows - 1:
            sample.append(left)
            size += len(left)
            left = next(records, None)
        own = dictionary(sample)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True).compress
        if own is None:
            yield None
        else:
            packed = zstandard.ZstdCompressor(level=19).compress(own.as_bytes())
            yield DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed
        rows = 1
        while sample:
            yield compress(sample.pop(0))
            rows += 1
        while left is not None and rows < most_rows and size < most_bytes:
            yield compress(left)
            rows, size = rows + 1, size + len(left)
            left = next(records, None)
        if left is not None:
            yield from [None] * (most_rows - rows)


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """One row per page: page_id, url, payload (NULL for revisits), and what its record needs.

    Payloads are compared by SHA-256 and length. Only digests are shuffled, and of those
    of copies only what their revisits say.
    """
    pages, key = keyed(pages)
    whole = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(F.col(key).alias("key"), F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), whole.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    size = F.octet_length("payload").cast("long")
    rows = stored(own.select("key", "page_id", digest.alias("digest"), F.sha1("payload").alias("sha1"), size.alias("bytes")))
    best = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "key"))
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    groups = stored(groups.where("n > 1").select("digest", "bytes", "n", F.col("best.key").alias("first"), F.col("best.page_id").alias("refers_to")))
    again = join_groups(rows, groups, ["digest", "bytes"], "n").where("key <> first").select("key", "refers_to", "sha1", "bytes")
    full = own.join(small(stored(again)), "key", "left")
    first = F.col("sha1").isNull()
    return full.select(
        "page_id", "url", F.when(first, F.col("payload")).alias("payload"), digest.alias("digest"), "sha1", "bytes", "refers_to",
        (F.octet_length("payload") >= least_bytes).alias("own"), "key.file", "key.row",
    )


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, date: str = DATE, most_rows: int = RECORDS, most_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes one WARC record per page to archives in the folder `path`.

    The payload is the html in UTF-8, empty for NULL. Of pages with equal payloads of at
    least `least_bytes` bytes the one of smallest page_id (NULL is largest; of repeated rows
    any one, the same in each run over the same files) is a response and the others revisit it. Control
    characters and spaces of a URL are written as %XX, a NULL url or id leaves its header out. An empty
    table gives a folder without records.

    An archive is a Zstandard file as WARC readers know it: a skippable frame with the
    dictionary, built from the archive's first records, then one frame per record, with empty
    skippable frames between. Spark's text writer commits the files, so a lost task leaves
    none behind; they bear its names. Archives close after `most_rows` rows or `most_bytes`.
    """
    rows = with_revisits(pages, page_id, url, html, least_bytes)

    def write(batches):
        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for row in batch.slice(at, 256).to_pylist():
                        yield page_record(row, date)

        part, size = [], 0
        for row in archive_rows(records(), most_rows, most_bytes, archive_info(date)):
            part.append(row)
            size += len(row or b"")
            if size > 4 << 20 or len(part) >= 8192:
                yield pa.RecordBatch.from_pydict({"data": pa.array(part, pa.binary())})
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_pydict({"data": pa.array(part, pa.binary())})

    data = rows.mapInArrow(write, "data binary").select(F.col("data").cast("string").alias("value"))
    data.write.option("lineSep", GAP).option("maxRecordsPerFile", most_rows).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, told from its block headers."""
    end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    checksum = data[at + 4] >> 2 & 1
    last = 0
    while not last:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * checksum


def frames(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of an archive."""
    decompress = zstandard.ZstdDecompressor().decompress
    at = 0
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if SKIPPABLE.fullmatch(magic):
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                own = bytes(data[8:end])
                own = zstandard.ZstdDecompressor().decompress(own) if own[:4] == FRAME_MAGIC else own
                decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)).decompress
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield at, end - at, decompress(data[at:end])
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")
        at = end


def head_and_block(data: bytes) -> tuple[dict[str, str], bytes]:
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}, block


def read_record(data: bytes) -> tuple[dict, bytes] | None:
    """What a page's record says, and its payload; None for other records. A wrong length or digest is an error."""
    fields, block = head_and_block(data)
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    block = block[: int(fields["content-length"])]
    http, payload = head_and_block(block)
    size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload), base32(hashlib.sha1(payload).digest())) != (size, digest):
        raise ValueError(f"record {fields['warc-record-id']} is not what its header says")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id"), "record_id": fields["warc-record-id"],
    }, payload


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per page's record in the archives of `path`, with its place; `payload` adds the payload of responses.

    Each payload is held against the length and digest of its header.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(COLUMNS + (", payload binary" if payload else ""))
    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, part, size = batch.column(0)[i].as_py(), [], 0
                for offset, length, data in frames(memoryview(batch.column(1)[i].as_buffer())):
                    found = read_record(data)
                    if found is None:
                        continue
                    row = found[0] | {"archive": name, "offset": offset, "length": length}
                    if payload:
                        row["payload"] = found[1] if row["record_type"] == "response" else None
                    part.append(row)
                    size += len(data) if payload else 0
                    if len(part) >= 4096 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(part, arrow)
                        part, size = [], 0
                yield pa.RecordBatch.from_pylist(part, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, schema)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes `pages` to archives in the shared folder and returns what a reader finds there."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
