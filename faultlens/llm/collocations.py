"""Phrase collocations: all positions of the corpus walk double-array tries of phrases that can be frequent.

Where these are too many for a trie that the driver can hold, filters of the phrases one word
shorter take its place, and what passes them is counted.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import stored
from faultlens.llm.near_dedup import mixed
from faultlens.plans.bounded import is_small

LEAST = 30
LONGEST = 4
# A phrase goes where a longer one that holds it has this share, in percent, of its count.
SHARE = 80
TOP = 2000
# What may be broadcast: frequent words and their bytes, and phrases of a trie, which the driver builds. With more
# phrases they are counted level by level, with more words by a shuffle of their texts.
MOST_WORDS, MOST_WORD_BYTES = 2_000_000, 64 << 20
MOST_PHRASES = 1_000_000
# Bits per phrase of a filter, and the most bits it may have (16 MB). A fuller one lets more phrases be counted, in vain.
BITS_PER_PHRASE, MOST_BITS, CHUNK_BITS = 16, 1 << 27, 1 << 16
# Ids of a stored block, positions whose phrases a task holds at a time, words a task counts before it hands them on.
BLOCK = 1 << 20
HELD_POSITIONS = 2 << 20
HELD_WORDS = 200_000
# States whose counts are summed together.
RANGE = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Where pieces end. No UTF-8 text holds the byte that stands for them.
ENDS = ".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
TO_BREAK = bytes.maketrans(ENDS.encode(), BREAK * len(ENDS))


def tokens(text: str) -> list[bytes]:
    """The words of a text in order, with BREAK where pieces end. bytes.lower touches A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().translate(TO_BREAK).replace(BREAK, b" " + BREAK + b" ").split()


def texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def rows_of(batches) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, f) over texts (lang, text), each task adding up its own."""

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(BREAK, None)
                words, n = list(own), list(own.values())
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part)), "word": pa.array(part, pa.binary()), "f": pa.array(n[at : at + 50_000], pa.int64())})
            counts.clear()

        for lang, text in rows_of(batches):
            counts[lang].update(tokens(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from hand_on()
        yield from hand_on()

    counted = rows.mapInArrow(run, "lang string, word binary, f long")
    return counted.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f"))


class Vocabulary:
    """Frequent words in the order of their ids, which begin at 1. Arrow columns; only tasks that encode texts make Python objects of them."""

    def __init__(self, words: pa.Table):
        self.langs, self.words = (words.column(c).combine_chunks() for c in ("lang", "word"))
        self.langs = self.langs.dictionary_encode()
        self._ids: dict[str, dict[bytes, int]] | None = None

    def __len__(self) -> int:
        return len(self.words)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ids": None}

    @property
    def ids(self) -> dict[str, dict[bytes, int]]:
        if self._ids is None:
            self._ids = defaultdict(dict)
            for at in range(0, len(self), 50_000):
                langs, words = (x[at : at + 50_000] for x in (self.langs, self.words))
                for i, (lang, word) in enumerate(zip(langs.to_pylist(), words.cast(pa.binary()).to_pylist()), at + 1):
                    self._ids[lang][word] = i
        return self._ids

    def phrases(self, ids: list[np.ndarray], f: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, f) of phrases given by the ids of their first, second, ... words."""
        words = pc.binary_join_element_wise(*[self.words.take(pa.array(i.astype("i8") - 1)) for i in ids], " ")
        langs = self.langs.take(pa.array(ids[0].astype("i8") - 1)).cast(pa.string())
        return pa.RecordBatch.from_pydict({"lang": langs, "phrase": words, "f": pa.array(f, pa.int64())})


NAMED = "lang string, phrase string, f long"


def encode(rows: DataFrame, shared) -> DataFrame:
    """Blocks (ids binary) of the ids of all words; 0 stands for piece ends, texts' ends and words without an id.

    Words that no neighbour with an id stands beside are left out, as no phrase holds them.
    """

    def run(batches):
        known, none = shared.value.ids, {}
        held: list[int] = []

        def block() -> pa.RecordBatch:
            x = np.array([0, *held, 0], "<i4")
            beside = np.zeros(len(x), bool)
            beside[1:] |= x[:-1] > 0
            beside[:-1] |= x[1:] > 0
            x = x[(x > 0) & beside | (x == 0)]
            x = np.append(x[:-1][(x[:-1] > 0) | (x[1:] > 0)], 0).astype("<i4")
            held.clear()
            return pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes()], pa.binary())})

        for lang, text in rows_of(batches):
            held.extend(map(known.get(lang, none).get, tokens(text), repeat(0)))
            held.append(0)
            if len(held) >= BLOCK:
                yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, "ids binary")


class Trie:
    """A double array: state s moves with symbol c to t = base[s] + c if check[t] is s, and to 0 otherwise.

    States 1 to n are the words themselves. A word is two symbols, its high and its low
    bits, so that the children of a state lie close together.
    """

    BITS = 9
    TRIES = 24

    def __init__(self, words: int):
        self.symbols = max(words >> self.BITS, (1 << self.BITS) - 1) + 1
        self.first = max(words, self.symbols) + 1
        self.base, self.check = np.zeros(self.first + self.symbols, "i4"), np.full(self.first + self.symbols, -1, "i4")
        self.used = np.zeros(self.first + self.symbols, bool)
        self.used[: self.first] = True
        self.end = self.first

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self._move(self._move(states, words >> self.BITS), words & (1 << self.BITS) - 1)

    def _move(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        to = self.base[states] + symbols
        return np.where(self.check[to] == states, to, 0)

    def states(self, ids: np.ndarray, length: int) -> np.ndarray:
        """The state each position reaches with the `length` words that begin there, or 0."""
        at = ids
        for k in range(1, length):
            at = self.step(at[: len(ids) - k], ids[k:])
        return at

    def add(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """New states for distinct (state, word); a state gets all its children in one call."""
        high = words >> self.BITS
        pairs, which = np.unique(states.astype("i8") << 32 | high, return_inverse=True)
        between = self._place(pairs >> 32, pairs & 0xFFFFFFFF)
        return self._place(between[which.ravel()], words & (1 << self.BITS) - 1)

    def words(self, states: np.ndarray, length: int) -> list[np.ndarray]:
        """The words on the way to states of phrases of `length` words."""
        out = []
        for _ in range(length - 1):
            between = self.check[states]
            before = self.check[between]
            out.append((between - self.base[before]) << self.BITS | states - self.base[between])
            states = before
        return [states, *reversed(out)]

    def lengths(self, states: np.ndarray) -> np.ndarray:
        out, at = np.ones(len(states), int), states
        while (more := self.check[at] >= 0).any():
            at = np.where(more, self.check[np.maximum(self.check[at], 0)], at)
            out += more
        return out

    def _place(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        order = np.lexsort((symbols, states))
        states, symbols = states[order], symbols[order]
        starts = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
        sizes = np.diff(np.append(starts, len(states)))
        low = self.first
        for at, n in sorted(zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()), key=lambda x: -x[1]):
            own = symbols[at : at + n]
            base, low = self._fit(own, low)
            self._settle(states[at : at + n], own, np.full(n, base))
        alone = starts[sizes == 1]
        self._room(len(alone))
        free = np.flatnonzero(~self.used[: self.end + len(alone)])[: len(alone)]
        self._settle(states[alone], symbols[alone], free - symbols[alone])
        slots = np.empty(len(order), "i8")
        slots[order] = self.base[states] + symbols
        return slots

    def _room(self, n: int) -> None:
        """Space for `n` more states behind the last one, and for any symbol from there."""
        if (more := self.end + n + 2 * self.symbols - len(self.check)) > 0:
            more += len(self.check) // 2
            self.base = np.append(self.base, np.zeros(more, "i4"))
            self.check = np.append(self.check, np.full(more, -1, "i4"))
            self.used = np.append(self.used, np.zeros(more, bool))

    def _fit(self, symbols: np.ndarray, low: int) -> tuple[int, int]:
        """A base at which all `symbols` find free slots, looking from `low` on; and where to look next."""
        self._room(0)
        free = np.flatnonzero(~self.used[low : min(low + 4096, self.end)])[: self.TRIES] + low
        for slot in free.tolist():
            base = slot - int(symbols[0])
            if not self.used[base + symbols].any():
                return base, int(free[0])
        return self.end - int(symbols[0]), int(free[len(free) // 2]) if len(free) else min(low + 4096, self.end)

    def _settle(self, states: np.ndarray, symbols: np.ndarray, bases: np.ndarray) -> None:
        slots = bases + symbols
        self.base[states], self.check[slots], self.used[slots] = bases, states, True
        if len(slots):
            self.end = max(self.end, int(slots.max()) + 1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.end + self.symbols
        self._room(0)
        return self.base[:size], self.check[:size]

    @classmethod
    def of(cls, base: np.ndarray, check: np.ndarray) -> Trie:
        self = cls.__new__(cls)
        self.base, self.check = base, check
        return self


def id_blocks(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield np.frombuffer(batch.column(0)[i].as_buffer(), "<i4")


def candidates(blocks: DataFrame, shared, length: int, least: int, buckets: int) -> DataFrame:
    """(code) of phrases of `length` words that can reach `least`: code is the state of all but the last word, and that of all but the first.

    A position counts where both of these phrases are candidates themselves. Each
    task adds up its codes and deals them to buckets by hash; sums are kept up to
    `least` only, since more says nothing.
    """
    kind = "u1" if least < 256 else "<u4"

    def run(batches):
        trie = Trie.of(*shared.value)
        held, size = [], 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, least).astype(kind)
            bucket = (mixed(codes.view("u8")) % np.uint64(buckets)).astype("i4")
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(ends))
            part = [order[ends[b] : ends[b + 1]] for b in some]
            columns = {"bucket": pa.array(some, pa.int32()), "codes": [codes[p].tobytes() for p in part], "counts": [counts[p].tobytes() for p in part]}
            yield pa.RecordBatch.from_pydict(columns)

        for ids in id_blocks(batches):
            at = trie.states(ids, length - 1)
            both = (at[:-1] > 0) & (at[1:] > 0)
            held.append(at[:-1][both].astype("i8") << 32 | at[1:][both])
            size += len(held[-1])
            if size >= HELD_POSITIONS:
                yield from hand_on()
                held, size = [], 0
        if size:
            yield from hand_on()

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.frombuffer(x, "<i8") for x in group["codes"]])
        counts = np.concatenate([np.frombuffer(x, kind) for x in group["counts"]])
        codes, which = np.unique(codes, return_inverse=True)
        return pd.DataFrame({"code": codes[np.bincount(which, weights=counts) >= least]})

    dealt = blocks.mapInArrow(run, "bucket int, codes binary, counts binary")
    return dealt.groupBy("bucket").applyInPandas(add_up, "code long")


def count_states(blocks: DataFrame, shared, longest: int) -> DataFrame:
    """(state, f): how many positions reach each state with 2 to `longest` words.

    Every task counts into one array and hands on what it has met, in ranges of
    states; the arrays of a range are summed together.
    """

    def run(batches):
        trie = Trie.of(*shared.value)
        total = np.zeros(len(trie.check), "i8")
        for ids in id_blocks(batches):
            at = ids
            for k in range(1, longest):
                at = trie.step(at[: len(ids) - k], ids[k:])
                total += np.bincount(at, minlength=len(total))
        total[0] = 0
        some = np.flatnonzero(total)
        ends = np.searchsorted(some, np.arange(0, len(total) + RANGE, RANGE))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            own = some[ends[i] : ends[i + 1]]
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "states": [own.astype("<i4").tobytes()], "counts": [total[own].tobytes()]})

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        first = int(group["part"].iloc[0]) * RANGE
        total = np.zeros(RANGE, "i8")
        for states, counts in zip(group["states"], group["counts"]):
            total[np.frombuffer(states, "<i4") - first] += np.frombuffer(counts, "<i8")
        some = np.flatnonzero(total)
        return pd.DataFrame({"state": (some + first).astype("i4"), "f": total[some]})

    shards = blocks.mapInArrow(run, "part int, states binary, counts binary")
    return shards.groupBy("part").applyInPandas(add_up, "state int, f long")


def planes(values: np.ndarray) -> bytes:
    """The values byte by byte, all first bytes first: what a shuffle's compression makes most of."""
    return np.ascontiguousarray(values.view("u1").reshape(len(values), -1).T).tobytes()


def from_planes(parts: pd.Series, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, "u1").reshape(size, -1).T).view(kind).ravel() for x in parts])


def packed(words: list[np.ndarray]) -> list[np.ndarray]:
    """Two words to a number."""
    words = [w.astype("i8") for w in words]
    return [words[i] << 32 | (words[i + 1] if i + 1 < len(words) else 0) for i in range(0, len(words), 2)]


def summed(keys: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys, each given by all columns, and the sums of their counts (of ones)."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = reduce(np.logical_or, [np.append(True, k[1:] != k[:-1]) for k in keys]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order].astype("i8"), first) if len(first) else np.zeros(0, "i8")
    return [k[first] for k in keys], total


def hashed(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(words[0]), "u8")
    for w in words:
        out = mixed(out + w.astype("u8") + np.uint64(1))
    return out


def bits_of(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of phrases in a filter of `bits` bits."""
    h = hashed(words)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def filter_of(found: DataFrame, length: int) -> np.ndarray:
    """A Bloom filter of phrases (w0, w1, ..., f), as bytes: made by chunks in tasks, and the whole has at most MOST_BITS."""
    bits, n = CHUNK_BITS, found.count()
    while bits < min(BITS_PER_PHRASE * n, MOST_BITS):
        bits *= 2

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.unique(np.concatenate(bits_of([batch.column(i).to_numpy() for i in range(length)], bits)).astype("i8"))
            ends = np.searchsorted(at, np.arange(0, bits + 1, CHUNK_BITS))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "at": [(at[ends[c] : ends[c + 1]] % CHUNK_BITS).astype("<u2").tobytes() for c in some]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(CHUNK_BITS, bool)
        own[np.frombuffer(b"".join(group["at"]), "<u2")] = True
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    chunks = found.select(*[f"w{i}" for i in range(length)]).mapInArrow(place, "chunk int, at binary").groupBy("chunk").applyInPandas(join, "chunk int, bits binary")
    whole = np.zeros((bits // CHUNK_BITS, CHUNK_BITS // 8), "u1")
    for chunk in chunks.toLocalIterator():
        whole[chunk["chunk"]] = np.frombuffer(chunk["bits"], "u1")
    return whole.ravel()


def passes(bits: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    a, b = bits_of(words, len(bits) * 8)
    held = lambda x: (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype("u1")) & 1
    return (held(a) & held(b)).astype(bool)


def level(blocks: DataFrame, length: int, least: int, buckets: int, shorter=None) -> DataFrame:
    """(w0, w1, ..., f) of phrases of `length` words, as ids, that occur `least` times or more.

    A position counts where both phrases one word shorter pass the filter `shorter`, if there is one. Each
    task adds up what it has met and deals it to buckets by hash, where the sums are whole.
    """
    columns = (length + 1) // 2

    def run(batches):
        bits = shorter.value if shorter else None
        held, size = [], 0

        def hand_on() -> pa.RecordBatch:
            keys, counts = summed([np.concatenate(k) for k in zip(*held)])
            bucket = (hashed(keys) % np.uint64(buckets)).astype("i4")
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(ends))
            part = [order[ends[b] : ends[b + 1]] for b in some]
            made = {f"k{i}": [planes(k[p]) for p in part] for i, k in enumerate(keys)}
            counts = counts.astype("<u4")
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), **made, "counts": [planes(counts[p]) for p in part]})

        for ids in id_blocks(batches):
            if len(ids) < length:
                continue
            n = len(ids) - length + 1
            at = np.flatnonzero(reduce(np.logical_and, [ids[i : i + n] > 0 for i in range(length)]))
            words = [ids[at + i] for i in range(length)]
            if bits is not None and len(at):
                for part in (slice(0, length - 1), slice(1, length)):
                    own = passes(bits, words[part])
                    words = [w[own] for w in words]
            held.append(packed(words))
            size += len(words[0])
            if size >= HELD_POSITIONS:
                yield hand_on()
                size = 0
        if size:
            yield hand_on()

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        keys, f = summed([from_planes(group[f"k{i}"], "<i8") for i in range(columns)], from_planes(group["counts"], "<u4"))
        keys, f = [k[f >= least] for k in keys], f[f >= least]
        words = [w for k in keys for w in (k >> 32, k & 0xFFFFFFFF)][:length]
        return pd.DataFrame({f"w{i}": w.astype("i4") for i, w in enumerate(words)} | {"f": f})

    dealt = blocks.mapInArrow(run, f"bucket int, {', '.join(f'k{i} binary' for i in range(columns))}, counts binary")
    return dealt.groupBy("bucket").applyInPandas(add_up, f"{', '.join(f'w{i} int' for i in range(length))}, f long")


def count_by_levels(blocks: DataFrame, pairs: DataFrame, vocabulary, least: int, longest: int, buckets: int) -> DataFrame:
    """As `count_by_tries`, of any number of phrases, from those of two words on: nothing that grows with them passes the driver."""
    context, found, named = blocks.sparkSession.sparkContext, pairs, []
    for length in range(2, longest + 1):
        if length > 2:
            shorter = context.broadcast(filter_of(found, length - 1))
            found = stored(level(blocks, length, least, buckets, shorter))
            shorter.unpersist()

        def names(batches, length=length):
            for batch in batches:
                yield vocabulary.value.phrases([batch.column(i).to_numpy() for i in range(length)], batch.column(length).to_numpy())

        named.append(found.mapInArrow(names, NAMED))
    return reduce(DataFrame.unionByName, named)


def count_by_tries(rows: DataFrame, frequent: DataFrame, words: int, least: int, longest: int) -> DataFrame | None:
    """(lang, phrase, f) of phrases of 2 to `longest` words with f of `least` or more; None if the words are too many to broadcast.

    Each level's candidates extend those of the level before, so the trie
    grows by one level a round and holds no phrase whose parts are rare. The
    counts are those of the accepting states, summed over tasks. More phrases than a trie may
    have are counted by `count_by_levels`.
    """
    context = rows.sparkSession.sparkContext
    if not is_small(frequent, MOST_WORDS, MOST_WORD_BYTES):
        return None
    known = Vocabulary(frequent.orderBy(F.col("f").desc(), "lang", "word").select("lang", "word").toArrow())
    vocabulary = context.broadcast(known)
    blocks = stored(encode(rows, vocabulary))
    trie = Trie(len(known))
    buckets = words // HELD_POSITIONS + context.defaultParallelism
    pairs = stored(level(blocks, 2, least, buckets))
    # Of the last level: states in order, and the last words on the way there.
    states = last = np.arange(1, len(known) + 1)
    left = MOST_PHRASES
    for length in range(2, longest + 1):
        if length == 2:
            found = pairs.select((F.col("w0").cast("long") * (1 << 32) + F.col("w1")).alias("code"))
        else:
            shared = context.broadcast(trie.arrays())
            found = stored(candidates(blocks, shared, length, least, buckets))
            shared.unpersist()
        if not is_small(found, left):
            return count_by_levels(blocks, pairs, vocabulary, least, longest, buckets)
        codes = np.sort(found.toArrow().column("code").to_numpy())
        if not len(codes):
            break
        left -= len(codes)
        ends = last[np.searchsorted(states, codes & 0xFFFFFFFF)]
        made = trie.add(codes >> 32, ends)
        order = np.argsort(made)
        states, last = made[order], ends[order]
    shared = context.broadcast(trie.arrays())

    def names(batches):
        trie = Trie.of(*shared.value)
        for batch in batches:
            states, f = (batch.column(i).to_numpy() for i in range(2))
            states, f = states[f >= least], f[f >= least]
            lengths = trie.lengths(states)
            for length in np.unique(lengths).tolist():
                yield vocabulary.value.phrases(trie.words(states[lengths == length], length), f[lengths == length])

    return count_states(blocks, shared, longest).mapInArrow(names, NAMED)


def count_by_shuffle(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """As `count_by_tries`, of any number of words: each occurrence of a phrase is grouped by its words."""
    pieces = rows.select("lang", F.explode(F.split(F.translate("text", UPPER, LOWER), r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(r"[^\x20\x09]+"), F.lit(0)).alias("w"))

    def spans(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))
        return F.when(F.size("w") >= k, every).otherwise(F.array())

    every = F.flatten(F.array(*map(spans, range(2, longest + 1))))
    counts = words.where(F.size("w") > 1).select("lang", F.explode(every).alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f"))
    return counts.where(F.col("f") >= least)


def exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def score_cuts(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, k, score) of each phrase's lowest-scoring cut, the first one of several."""
    parts = frequent.select("lang", F.col("word").alias("phrase"), "f").unionByName(phrases)
    cut = phrases.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    joined = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w")).alias("right"))
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    both = both.withColumns({"top": F.lit(2_000_000).cast("decimal(7,0)") * exact(F.col("a")), "bottom": exact(F.col("l")) + exact(F.col("r"))})
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.k", "cut.score")


def held_by_longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer phrase that holds it, for phrases of two words or more."""
    w = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 2)
    inner = w.select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("n"))
    inner = inner.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP,
) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z) and parted by spaces and tabs; phrases of 2 to `longest` words do not pass
    `.,;:!?` or line ends. A phrase counts from `least` occurrences on (`a`, overlaps
    included). `l` and `r` are the counts of its parts at the cut with the lowest score
    floor(2,000,000 a / (l + r)), the first of several such. A phrase inside a longer
    one with `share` percent of its count is left out. Ranks go by score, a, then the
    phrase's bytes; n counts the language's words.

    A NULL text is empty, a NULL language `und`; repeated rows count each. Other columns, whatever
    their names, are not read. An empty table, or one without such a phrase, gives an empty result.
    """
    rows = texts(docs, text, lang)
    words = stored(count_words(rows))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    n = words.agg(F.sum("f")).first()[0] or 0
    phrases = count_by_tries(rows, frequent, n, least, longest)
    phrases = stored(count_by_shuffle(rows, least, longest) if phrases is None else phrases)
    kept = score_cuts(phrases, frequent).join(held_by_longer(phrases), ["lang", "phrase"], "left")
    inside = F.coalesce(100 * exact(F.col("longer")) >= share * exact(F.col("a")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = kept.where(~inside).withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
