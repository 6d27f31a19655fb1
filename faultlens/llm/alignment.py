"""Cross-tokenizer alignment: the token ends of two vocabularies merged along merge paths."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import map_texts, stored

# Ends that one piece of a merge takes from both sides together.
PIECE = 1 << 15
# Text that is encoded and merged at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


class Vocabularies:
    """Two tokenizers that cut the same bytes: A from a rank file, B from a sentencepiece model.

    The text is encoded with a space before it. B adds that space itself. `pairs` are
    the codes a * |B| + b of all tokens that can end together: one must be a suffix of the other,
    which bounds the table of pairs by the two vocabularies, whatever the corpus is.
    """

    def __init__(self, ranks: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            entries = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=entries, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=model)
        bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            bytes_a[i] = token
        bytes_b = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        self.n_b = len(bytes_b)
        self.bytes = tuple(pa.array(x, pa.binary()) for x in (bytes_a, bytes_b))
        self.lengths = tuple(np.array(list(map(len, x)), "int64") for x in (bytes_a, bytes_b))
        self.pairs = self._ending_together(bytes_a, bytes_b)
        # What follows a token in the text of the groups: A knows "," and "|", B knows ",", ";" and nothing.
        written = [f"{i}{x}" for i in range(len(bytes_a)) for x in ",|"] + [f"{i}{x}" for i in range(self.n_b) for x in (",", ";", "")]
        self.written, self.first_b = pa.array(written, pa.binary()), 2 * len(bytes_a)

    def _piece_bytes(self, i: int) -> bytes:
        if self._b.is_control(i) or self._b.is_unknown(i):
            return b""
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _ending_together(bytes_a: list[bytes], bytes_b: list[bytes]) -> np.ndarray:
        by_bytes: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        for ids, tokens in zip(by_bytes, (bytes_a, bytes_b)):
            for i, token in enumerate(tokens):
                if token:
                    ids[token].append(i)
        pairs = set()
        for token, own in by_bytes[0].items():
            pairs.update(a * len(bytes_b) + b for k in range(len(token)) for b in by_bytes[1].get(token[k:], ()) for a in own)
        for token, own in by_bytes[1].items():
            pairs.update(a * len(bytes_b) + b for k in range(len(token)) for a in by_bytes[0].get(token[k:], ()) for b in own)
        return np.array(sorted(pairs), "int64")

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [self._a.encode_to_numpy(" " + t, disallowed_special=()).astype("int64") for t in texts]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "int64") for ids in self._b.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def vocabularies(ranks: str, pattern: str, model: str) -> Vocabularies:
    """Loaded once per Python worker."""
    return Vocabularies(ranks, pattern, model)


def diagonals(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted `a` and `b` lie before each diagonal, `size` apart, of their merge.

    Equal values of `a` come before those of `b`. All diagonals are searched at once.
    """
    d = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[d[open_] - 1 - mid]
        low[open_[more]] = mid[more] + 1
        high[open_[~more]] = mid[~more]
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `a` and in `b` of the ends both have, found piece by piece.

    Pieces take `size` ends each and know nothing of one another. An end whose two
    sides fell to either side of a diagonal is stitched in between their pieces.
    """
    at_a, at_b = diagonals(a, b, size)
    found_a, found_b = [], []
    for i, j, i_end, j_end in zip(at_a, at_b, at_a[1:], at_b[1:]):
        if i and j < len(b) and a[i - 1] == b[j]:
            found_a.append(np.array([i - 1]))
            found_b.append(np.array([j]))
        if i < i_end and j < j_end:
            own, other = a[i:i_end], b[j:j_end]
            place = np.searchsorted(other, own)
            same = np.flatnonzero(other[np.minimum(place, len(other) - 1)] == own)
            found_a.append(i + same)
            found_b.append(j + place[same])
    empty = [np.empty(0, "int64")]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def joined(table: pa.Array, ids: np.ndarray) -> bytes:
    """The entries of `table` one after the other."""
    return b"".join(pc.take(table, pa.array(ids)).to_pylist()) if len(ids) < 64 else _data(pc.take(table, pa.array(ids)))


def _data(entries: pa.Array) -> bytes:
    offsets = np.frombuffer(entries.buffers()[1], "<i4", len(entries) + 1, entries.offset * 4)
    return entries.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]


def encode_both(voc: Vocabularies, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of each text; none where the bytes of either side are not those of space and text."""
    a, b = voc.encode_a(texts), voc.encode_b(texts)
    for i, text in enumerate(texts):
        whole = b" " + text.encode()
        if not text or joined(voc.bytes[0], a[i]) != whole or joined(voc.bytes[1], b[i]) != whole:
            a[i] = b[i] = np.empty(0, "int64")
    return a, b


def write_groups(voc: Vocabularies, a: np.ndarray, b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """The text `a1,a2|b1;a3|b2,b3` of each document; `firsts` are the numbers of their first groups, and the end."""
    before_a, before_b = np.append(-1, link_a[:-1]), np.append(-1, link_b[:-1])
    size_a, size_b = link_a - before_a, link_b - before_b
    # Group g is written after all tokens of the groups before it: its A tokens, then its B tokens.
    out = np.empty(len(a) + len(b), "int64")
    out[np.arange(len(a)) + np.repeat(before_b + 1, size_a)] = 2 * a + np.isin(np.arange(len(a)), link_a, assume_unique=True)
    kind = np.zeros(len(b), "int64")
    kind[link_b] = 1
    ends = firsts[1:][firsts[1:] > firsts[:-1]] - 1
    kind[link_b[ends]] = 2
    out[np.arange(len(b)) + np.repeat(link_a + 1, size_b)] = voc.first_b + 3 * b + kind
    written = pc.take(voc.written, pa.array(out))
    data, offsets = written.buffers()[2], np.frombuffer(written.buffers()[1], "<i4", len(written) + 1)
    if not len(out):
        return [b""] * (len(firsts) - 1)
    tokens = np.append(0, link_a + link_b + 2)
    at = offsets[tokens[firsts]].tolist()
    view = memoryview(data)
    return [bytes(view[x:y]) for x, y in zip(at, at[1:])]


def aligned(docs: DataFrame, payload: Column, ranks: str, pattern: str, model: str, text: str = "text", digest: bool = False) -> DataFrame:
    """(payload, n_a, n_b, n_groups, n_links, groups, pairs, times) per document, not stored.

    `groups` is the text of the groups, or its SHA-256 in hex where `digest` is set; pairs
    are numbers in `Vocabularies.pairs` of the linked ids, times how often each is linked.
    """

    def start() -> Callable:
        voc = vocabularies(ranks, pattern, model)

        def align(texts: list[str]) -> tuple[None, dict]:
            made: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_links", "groups", "pairs", "times")}
            for first, end in batches_of(texts):
                _align(voc, texts[first:end], digest, made)
            lists = {}
            for c in ("pairs", "times"):
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in made[c]])))
                lists[c] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(made[c] or [np.empty(0)]).astype("int32")))
            return None, made | lists | {"n_groups": made["n_links"]}

        return align

    columns = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"
    return map_texts(docs, payload, F.col(text), columns, start)


def _align(voc: Vocabularies, texts: list[str], digest: bool, made: dict[str, list]) -> None:
    ids_a, ids_b = encode_both(voc, texts)
    n_a, n_b = ([len(x) for x in ids] for ids in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    link_a, link_b = overlaps(np.cumsum(voc.lengths[0][a]), np.cumsum(voc.lengths[1][b]))
    # Every text ends in a link, so groups never pass from one text to the next.
    firsts = np.searchsorted(link_a, np.concatenate(([0], np.cumsum(n_a))))
    written = write_groups(voc, a, b, link_a, link_b, firsts)
    made["groups"] += [hashlib.sha256(w).hexdigest() if digest and w else w.decode() for w in written]
    made["n_a"] += n_a
    made["n_b"] += n_b
    made["n_links"] += np.diff(firsts).tolist()
    codes = a[link_a] * voc.n_b + b[link_b]
    for x, y in zip(firsts, firsts[1:]):
        own, times = np.unique(codes[x:y], return_counts=True)
        made["pairs"].append(np.searchsorted(voc.pairs, own))
        made["times"].append(times)


def count_pairs(rows: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, links): how often the pairs of `rows` (pairs, times) are linked, summed in each task first."""

    def add(batches):
        total = np.zeros(n_pairs, "int64")
        for batch in batches:
            pairs, times = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            if len(pairs):
                total += np.bincount(pairs, weights=times, minlength=n_pairs).astype("int64")
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"pair": pa.array(part, pa.int32()), "links": pa.array(total[part], pa.int64())})

    parts = rows.select("pairs", "times").mapInArrow(add, "pair int, links long")
    return parts.groupBy("pair").agg(F.sum("links").alias("links"))


def pair_counts(docs: DataFrame, ranks: str, pattern: str, model: str, text: str = "text") -> DataFrame:
    """(a_id, b_id, links): how many links of the corpus hold each pair of ids."""
    voc = vocabularies(ranks, pattern, model)
    counts = count_pairs(aligned(docs, F.lit(0), ranks, pattern, model, text, digest=True), len(voc.pairs)).collect()
    rows = [(*divmod(int(voc.pairs[r["pair"]]), voc.n_b), r["links"]) for r in counts]
    return docs.sparkSession.createDataFrame(rows, "a_id long, b_id long, links long")


def align(docs: DataFrame, payload: Column, ranks: str, pattern: str, model: str, text: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: payload, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Where a token of A and one of B end at the same byte, both are linked and a group of
    tokens that cover the same bytes ends. `n_best` counts the links whose pair is the most
    linked one of its B id in the corpus, ties included; `count_sum` adds up the
    corpus counts of the pairs over the links. `groups` is written as
    `a1,a2|b1;a3|b2,b3`, or is the SHA-256 of that with `digest`.

    A NULL or empty text, and one that either vocabulary does not spell byte for byte,
    has no tokens: zeros and an empty `groups`. Repeated rows count each. Other columns, whatever
    their names, are not read; an empty table gives an empty result.

    Texts are encoded once; their pairs are stored. Counts by pair go by the driver and
    to all workers: both vocabularies bound them.
    """
    voc = vocabularies(ranks, pattern, model)
    n_pairs, n_b = len(voc.pairs), voc.n_b
    rows = stored(aligned(docs, payload, ranks, pattern, model, text, digest))
    counts = np.zeros(n_pairs, "int64")
    found = count_pairs(rows, n_pairs).toPandas()
    counts[found["pair"].to_numpy("int64")] = found["links"].to_numpy("int64")
    of_b = voc.pairs % n_b
    highest = np.zeros(n_b, "int64")
    np.maximum.at(highest, of_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[of_b]))

    def score(batches):
        links, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            n = np.diff(pairs.offsets.to_numpy())
            pair, time = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype("int64")
            ends = np.concatenate(([0], np.cumsum(n)))
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (time * best[pair], time * links[pair])]
            n_best, count_sum = (pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, n_best, count_sum], names=[*names, "n_best", "count_sum"])

    names = ["payload", "n_a", "n_b", "n_groups", "n_links", "groups"]
    schema = rows.select(*names).schema.add("n_best", "long").add("count_sum", "long")
    return rows.mapInArrow(score, schema)
