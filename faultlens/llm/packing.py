"""Best-fit packing of token sequences by bin completion."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import map_texts, stored

CAPACITY = 2048
# Pieces that one task packs at a time. Every block leaves about one sequence open.
BLOCK = 4096
# Sequences fuller than this stay as they are; the pieces of others are packed again across blocks.
FULL = 0.98
# Steps of the search below an incumbent that misses the bound; then the incumbent stands. A solution
# takes as many steps as it has sequences, so where one in GAP of them could be saved the search has
# twice as many steps as the incumbent has sequences at least.
NODES, GAP = 1_000, 500
# Words whose ids a worker remembers, in each of two generations.
KNOWN_WORDS = 300_000
WHITE = re.compile(r"[\x20\x09-\x0D]+")
LATIN_END = "\u0250"
# How byte-level vocabularies write bytes: visible ones as themselves, the others from U+0100 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in VISIBLE)}
SYMBOLS = ".,;:!?#$%&*"
SEPARATORS = re.compile(r"[\x1c-\x1f]")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that its tasks share what it remembers."""
    return WordEncoder(path)


class WordEncoder(dict):
    """Token ids of texts as little-endian bytes, for a tokenizer that drops white space.

    No token spans white space, so a text's ids are those of its words one after the
    other. The encoder remembers the ids of words it has met.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model.tokenize
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.find(word)
        if len(self) >= KNOWN_WORDS:
            # Frequent words come back from the generation before.
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def find(self, word: str) -> bytes:
        # Symbols after a letter are tokens of their own, and letters lose their case first.
        core = word.rstrip(SYMBOLS)
        if core and core != word and core[-1].isalpha():
            return self[core] + self[word[len(core) :]]
        if word.isascii() and word != word.lower():
            return self[word.lower()]
        if word.isalpha() and word == word.lower() and max(word) < LATIN_END and is_normalized("NFC", word):
            # One run of lower-case letters: only the model is left to apply, on its bytes.
            ids = [t.id for t in self.model(word if word.isascii() else "".join(map(BYTES.__getitem__, word.encode())))]
        else:
            ids = self.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            # str.split also parts at the four separators, which the tokenizer takes for symbols.
            words = text.split() if not SEPARATORS.search(text) else WHITE.split(text)
            yield b"".join(map(self.__getitem__, words))


def cut_pieces(docs: DataFrame, payload: Column, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = 0, ids: bool = False) -> DataFrame:
    """(payload, piece, start, length, ids_crc32) per piece of at most `capacity` tokens; `ids` adds the ids.

    A document's tokens end with `end`. NULL counts as empty and so gives one token.
    """
    tail = np.array([end], "<u4").tobytes()
    width = 4 * capacity

    def start() -> Callable:
        encode = encoder(tokenizer)

        def cut(texts: list[str]) -> tuple[list[int], dict]:
            rows = []
            for i, data in enumerate(encode(texts)):
                data += tail
                for k in range(0, len(data), width):
                    part = data[k : k + width]
                    row = (i, k // width, k // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("int32")) if ids else row)
            index, *values = map(list, zip(*rows)) if rows else ([] for _ in range(6))
            return index, dict(zip(["piece", "start", "length", "ids_crc32", "ids"], values))

        return cut

    columns = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return map_texts(docs, payload, F.col(text), columns, start)


class Lengths:
    """A multiset of lengths up to `capacity`, with the queries that filling a sequence needs."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1)
        self.left = len(lengths)

    def take(self, xs: tuple[int, ...]) -> None:
        for x in xs:
            self.count[x] -= 1
        self.left -= len(xs)

    def put(self, xs: tuple[int, ...]) -> None:
        for x in xs:
            self.count[x] += 1
        self.left += len(xs)

    def largest(self, most: int) -> int:
        """The largest length present up to `most`, or 0."""
        found = np.flatnonzero(self.count[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0


def best_fit(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing: each length goes to the fullest sequence that holds it."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)
    done = []
    for x in np.sort(lengths)[::-1].tolist():
        room = x + int(has[x:].argmax())
        if has[room]:
            bin_ = by_room[room].pop()
            has[room] = bool(by_room[room])
        else:
            bin_, room = [], capacity
        bin_.append(x)
        if room == x:
            done.append(tuple(bin_))
        else:
            by_room[room - x].append(bin_)
            has[room - x] = True
    return done + [tuple(b) for bins in by_room for b in bins]


def fillings(left: Lengths, room: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill `room`, the fullest first.

    A filling is dominated if another one, not fuller than allowed, holds a length
    in place of a smaller length or of several. So a single length that fits exactly
    beats all others; of one-length fillings only the longest counts; a pair must
    beat it, each first length with the longest second; triples are looked at while
    no pair is exact. A room for many lengths takes the longest ones first.
    """
    head: tuple[int, ...] = ()
    one = left.largest(room)
    while one and room > 3 * one and left.count[one]:
        head += (one,)
        left.count[one] -= 1
        room -= one
        one = left.largest(room)
    try:
        if not one:
            return [head]
        if one == room:
            return [(*head, one)]
        lengths = np.flatnonzero(left.count[: room + 1])
        found = {(one,): one}

        def pairs(most: int, space: int) -> tuple[np.ndarray, np.ndarray]:
            """For each first length up to `most`, the longest second one that is not longer and fits."""
            xs = lengths[: np.searchsorted(lengths, min(most, space - 1), "right")]
            limit = np.minimum(xs - (left.count[xs] < 2), space - xs)
            at = np.searchsorted(lengths, limit, "right") - 1
            ok = at >= 0
            return xs[ok], lengths[at[ok]]

        xs, ys = pairs(room, room)
        sums = xs + ys
        better = np.flatnonzero(sums > one)
        for i in better[np.argsort(-sums[better], kind="stable")]:
            found[(int(xs[i]), int(ys[i]))] = int(sums[i])
        if not len(better) or sums[better].max() < room:
            full = max(found.values())
            for x in lengths[::-1].tolist():
                if x >= room:
                    continue
                if left.count[x] < 2:
                    xs, ys = pairs(x - 1, room - x)
                else:
                    xs, ys = pairs(x, room - x)
                    thrice = (xs == x) & (ys == x) & (left.count[x] < 3)
                    xs, ys = xs[~thrice], ys[~thrice]
                if not len(xs):
                    continue
                i = int((xs + ys).argmax())
                if x + int(xs[i] + ys[i]) > full:
                    full = x + int(xs[i] + ys[i])
                    found[(x, int(xs[i]), int(ys[i]))] = full
                if full == room:
                    break
        return [(*head, *f) for f in sorted(found, key=lambda f: -found[f])]
    finally:
        for x in head:
            left.count[x] += 1


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by total length, and as a bin holds at most k lengths over capacity / (k + 1)."""
    total = int(lengths.sum())
    return max(-(-total // capacity), *(-(-int((lengths > capacity // (k + 1)).sum()) // k) for k in range(1, 9)))


def complete_bins(lengths: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, ...]]:
    """Few bins for `lengths`: branch and bound on the fillings around the longest one left.

    The incumbent is best-fit decreasing. A branch ends when its waste leaves no room
    for one bin less than the incumbent has, and the search when the incumbent meets
    the bound (`least_bins`) or its steps are spent (`nodes`, or twice the bins where many could be saved).
    """
    best = best_fit(lengths, capacity)
    total = int(lengths.sum())
    bound = least_bins(lengths, capacity)
    if GAP * (len(best) - bound) >= len(best) > nodes // 2:
        nodes = 2 * len(best)
    left = Lengths(lengths, capacity)
    waste = 0
    path: list[tuple[int, ...]] = []
    open_: list[list[tuple[int, ...]]] = []

    def allowed() -> int:
        return (len(best) - 1) * capacity - total

    def branch() -> list[tuple[int, ...]]:
        x = left.largest(capacity)
        left.take((x,))
        ways = [(x, *f) for f in fillings(left, capacity - x)]
        left.put((x,))
        spare = allowed() - waste
        return [w for w in ways if capacity - sum(w) <= spare or sum(w) == total_left()][::-1]

    def total_left() -> int:
        return total - sum(map(sum, path))

    while len(best) > bound and nodes > 0:
        nodes -= 1
        if left.left and len(path) == len(open_):
            open_.append(branch())
        if left.left and open_[-1]:
            way = open_[-1].pop()
            left.take(way)
            waste += capacity - sum(way)
            path.append(way)
            if left.left == 0 and len(path) < len(best):
                best = list(path)
            elif waste <= allowed():
                continue
        elif left.left and open_:
            open_.pop()
        if not path:
            break
        while len(open_) > len(path):
            open_.pop()
        way = path.pop()
        left.put(way)
        waste -= capacity - sum(way)
        if not open_:
            break
    return best


def place(block: pd.DataFrame, capacity: int, nodes: int) -> pd.DataFrame:
    """Adds `bin` (number in the block), `offset` and `fill` to the pieces of one block."""
    lengths = block["length"].to_numpy()
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(capacity + 2))
    next_ = first.copy()
    bins, offsets, fills = (np.zeros(len(lengths), "int64") for _ in range(3))
    for b, way in enumerate(complete_bins(lengths, capacity, nodes)):
        at = 0
        for x in way:
            i = order[next_[x]]
            next_[x] += 1
            bins[i], offsets[i], fills[i] = b, at, sum(way)
            at += x
    return block.assign(bin=bins, offset=offsets, fill=fills)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """`pieces` (with `length`) plus sequence_id and offset, in as few sequences as found.

    Pieces are stored once and dealt to blocks by a running number, so blocks are even
    whatever ids repeat, and a repeated task deals them alike. Full pieces need no
    search. Sequences that stay under FULL are packed again across blocks.
    """
    rows = stored(pieces.withColumn("_n", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("_n") * 4, "offset": F.lit(0).cast("long")})

    def dealt(part: DataFrame, salt: int) -> DataFrame:
        blocks = max(1, -(-part.count() // block))
        few = part.select("_n", "length", F.pmod(F.xxhash64("_n", F.lit(salt)), F.lit(blocks)).alias("_block"))
        schema = "_n long, length long, _block long, bin long, offset long, fill long"
        placed = few.repartition(min(blocks, 10_000), "_block").groupBy("_block").applyInPandas(lambda g: place(g, capacity, nodes), schema)
        return placed.withColumn("sequence_id", (F.col("_block") * (1 << 24) + F.col("bin")) * 4 + salt)

    first = stored(dealt(rows.where(F.col("length") < capacity), 1))
    good = first.where(F.col("fill") >= FULL * capacity)
    again = dealt(first.where(F.col("fill") < FULL * capacity).select("_n", "length"), 2)
    found = good.select("_n", "sequence_id", "offset").unionByName(again.select("_n", "sequence_id", "offset"))
    packed = rows.where(F.col("length") < capacity).join(found, "_n")
    return full.unionByName(packed).drop("_n")


def pack_documents(docs: DataFrame, payload: Column, tokenizer: str, text: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs every row of `docs`; an empty table gives an empty result."""
    return pack(cut_pieces(docs, payload, tokenizer, text, capacity, ids=ids), capacity)
