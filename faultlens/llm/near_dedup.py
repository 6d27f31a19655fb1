"""Near-duplicates: banded MinHash candidates, thinned by odd sketches, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import join_groups, keyed, map_texts, stored

WIDTH = 5
PERCENT = 80
# 32 bands of 4: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
# The first BANDS * ROWS samples make the bands, all of them the sketch.
SAMPLES = 256
SKETCH_BITS = 2048
# A pair of similarity 0.8 differs in 51 of the 256 samples on average, with deviation 6.4. Each
# flips two bits: 84 samples, five deviations off, make 155 different bits, chance meetings aside.
MOST_DIFFERENT_BITS = 160
# Rounds at least in which each document meets one hub, before the pairs left are looked for.
HUB_ROUNDS = 2
KNOWN_WORDS = 100_000


class WordHashes(dict):
    """64-bit hashes of words, remembered per worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


@lru_cache(maxsize=1)
def family() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the MinHash functions x -> a x + b modulo 2^64."""
    r = np.random.default_rng(20240501)
    a, b = (r.integers(0, 1 << 64, SAMPLES, dtype="u8", endpoint=False) for _ in range(2))
    return a | np.uint64(1), b


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close ones apart."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingles of `width` words as 64-bit hashes; a shorter text is one shingle.

    bytes.lower touches A-Z only and bytes.split parts at ASCII white space only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(word_hashes().__getitem__, words), "u8", len(words))
    k = min(width, len(h))
    x = np.full(len(h) - k + 1, k, "u8")
    for i in range(k):
        x = mixed(x * np.uint64(0x100000001B3) + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def min_hashes(s: np.ndarray) -> np.ndarray:
    a, b = family()
    least = np.full(SAMPLES, np.iinfo("u8").max, "u8")
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return least


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    m = m[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    x = np.broadcast_to(np.arange(BANDS, dtype="u8"), m.shape[:2])
    for i in range(ROWS):
        x = mixed(x * np.uint64(0x100000001B3) + m[:, :, i])
    return x


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each (sample, value) flips one of SKETCH_BITS bits."""
    at = (mixed(m + np.arange(SAMPLES, dtype="u8") * np.uint64(0xD1B54A32D192ED03)) & np.uint64(SKETCH_BITS - 1)).astype("int64")
    n = len(m)
    bits = np.bincount((at + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(bits.astype("u1"), axis=1).view("<i8")


def signed(docs: DataFrame, payload: Column, text: str, width: int) -> DataFrame:
    """Stored (payload, n, n_shingles, sig, bands, sketch) per document; sig is NULL without words."""

    def start() -> Callable:
        def sign(texts: list[str]) -> tuple[None, dict]:
            sets = [shingles(t, width) for t in texts]
            m = np.array([min_hashes(s) for s in sets], "u8").reshape(-1, SAMPLES)
            some = np.array([len(s) > 0 for s in sets])

            def lists(values: np.ndarray) -> pa.Array:
                flat = pa.array(np.ascontiguousarray(values).view("<i8").ravel())
                return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)

            return None, {
                "n_shingles": [len(s) for s in sets],
                "sig": [xxhash.xxh3_128_digest(s.tobytes()) if k else None for s, k in zip(sets, some)],
                "bands": lists(band_keys(m)),
                "sketch": lists(odd_sketches(m)),
            }

        return sign

    columns = "n_shingles long, sig binary, bands array<long>, sketch array<long>"
    return stored(map_texts(docs, payload, F.col(text), columns, start).withColumn("n", F.monotonically_increasing_id()))


def similar(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose full sets are similar enough; `texts` has cid and text."""
    one = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def confirm(batches):
        last, last_set = None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, last_set = a, shingles(batch.column(2)[i].as_py(), width)
                other = shingles(batch.column(3)[i].as_py(), width)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(last_set) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp): the least node reachable over `edges` (a, b), for every node of an edge.

    Labels pass to neighbours and are then looked up once more, so chains halve with
    each round. Each round is stored.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), F.col("comp").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        passed = labels.join(near.withColumnRenamed("a", "cid"), "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        above = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("above"))
        step = stored(passed.join(above, "comp").select("cid", "old", F.least("comp", "above").alias("comp")))
        labels = step.select("cid", "comp")
        if step.where("comp <> old").isEmpty():
            return labels


def common_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(cid, own): how many shingles of each class no other one has. No partner can share those."""

    def start() -> Callable:
        def read(batch: list[str]) -> tuple[None, dict]:
            return None, {"shingles": [shingles(t, width).view("<i8") for t in batch]}

        return read

    every = map_texts(texts, F.col("cid"), F.col("text"), "shingles array<long>", start).select(F.col("payload").alias("cid"), F.explode("shingles").alias("x"))
    single = every.groupBy("x").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("cid")).where("k = 1")
    return single.groupBy("cid").agg(F.count(F.lit(1)).alias("own"))


def close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose sizes, own shingles and odd sketches allow the wanted similarity."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("common").alias(f"c_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(_may_match(percent)).select("a", "b")


def _may_match(percent: int) -> Column:
    most = F.least("c_a", "c_b")
    sizes = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    different = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return sizes & (different <= MOST_DIFFERENT_BITS)


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(cid, comp) of all classes that are linked to another one; `docs` has key and text.

    Members of a band's bucket first meet its hub only, one pair each: the member with
    the least share of shingles of its own, then the most others have too, that is the
    one closest to the rest. A
    second round does so with a hub outside the largest component. Documents of one
    group so become one component in linear work, and rounds go on while they still
    merge many. What is left are buckets with several components. Members whose own
    shingles rule out a link with anyone there have left; the others are paired by
    what they differ in from the hub (`_by_deltas`), which loses no link between
    components and does not look at all pairs of a bucket.
    """
    members = classes.select("cid", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("bucket")
    shared = stored(members.join(several, "bucket").select("bucket", "cid"))
    met = stored(classes.select("cid", "n_shingles", "sketch", "key").join(shared.select("cid").distinct(), "cid"))
    texts = stored(docs.select("key", F.coalesce("text", F.lit("")).alias("text")).join(met.select("cid", "key"), "key").select("cid", "text"))
    own = F.coalesce("own", F.lit(0))
    known = met.join(common_shingles(texts, width), "cid", "left").select(
        "cid", "n_shingles", "sketch", (F.col("n_shingles") - own).alias("common"), (own / F.col("n_shingles")).alias("own_share")
    )
    known = stored(known)

    labels, tested, edges, round_ = None, None, None, 0
    while True:
        open_ = stored(_open(shared, labels, known, percent))
        if open_.isEmpty():
            break
        pairs = _to_hubs(open_, known, percent, round_)
        fresh = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        found = stored(similar(fresh, texts, width, percent))
        tested = fresh if tested is None else tested.unionByName(fresh)
        edges = found if edges is None else edges.unionByName(found)
        merged = found.count()
        if labels is None or merged:
            labels = components(edges)
        round_ += 1
        # Rounds that still merge many members are cheaper than what follows.
        if round_ >= HUB_ROUNDS and merged * 50 < open_.select("cid").distinct().count():
            open_ = stored(_open(shared, labels, known, percent))
            if not open_.isEmpty():
                to_hubs, pairs = _by_deltas(open_, texts, width, percent)
                fresh = stored(pairs.join(tested, ["a", "b"], "left_anti"))
                labels = components(edges.unionByName(to_hubs).unionByName(similar(fresh, texts, width, percent)))
            break
    return labels if labels is not None else shared.select("cid", F.col("cid").alias("comp")).limit(0)


def _open(shared: DataFrame, labels: DataFrame | None, known: DataFrame, percent: int) -> DataFrame:
    """(bucket, cid, comp, n_shingles, common, own_share) of buckets with several components.

    Left out are members that cannot reach `percent` with anyone there: a partner has at
    least as many shingles as the bucket's smallest member, and `percent` of one's own,
    and shares none of one's own shingles.
    """
    named = shared.withColumn("comp", F.col("cid"))
    if labels is not None:
        named = shared.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    rows = named.join(known.drop("sketch"), "cid")
    least = rows.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n_shingles") * percent / 100))
    able = rows.join(least, "bucket").where(100 * F.col("common") >= percent * (F.col("n_shingles") + partner - F.col("common"))).drop("least")
    several = able.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return able.join(several, "bucket")


def _main(open_: DataFrame) -> DataFrame:
    """(bucket, main): the largest component of each bucket."""
    sizes = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"))


def _to_hubs(open_: DataFrame, known: DataFrame, percent: int, round_: int) -> DataFrame:
    """Each member with the best hub of another component that sizes and sketches allow."""
    outside = open_ if round_ == 0 else open_.join(_main(open_), "bucket").where("comp <> main")
    hub = F.min(F.struct("own_share", (-F.col("common")).alias("less"), "cid", "comp"))
    hubs = outside.groupBy("bucket").agg(hub.alias("x")).select("bucket", F.col("x.cid").alias("hub"), F.col("x.comp").alias("hub_comp"), F.col("x.own_share").alias("hub_share"))
    met = open_.join(hubs, "bucket").where("comp <> hub_comp").select("cid", "hub", "hub_share").distinct()
    pairs = met.select("cid", "hub_share", *ordered(F.col("cid"), F.col("hub")))
    fit = close(pairs.select("a", "b").distinct(), known, percent)
    return pairs.join(fit, ["a", "b"]).groupBy("cid").agg(F.min(F.struct("hub_share", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def deltas(met: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(hub, cid, n_hub, n, delta) for rows (hub, cid): the shingles that one of both has and the other has not."""
    sizes = stored(met.groupBy("hub").agg(F.count(F.lit(1)).alias("k")))
    hubs = sizes.join(texts.select(F.col("cid").alias("hub"), F.col("text").alias("hub_text")), "hub")
    both = join_groups(met.join(texts, "cid"), hubs, ["hub"], "k", 100).select("hub", "cid", "hub_text", "text")

    def differ(batches):
        last, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for hub, cid, hub_text, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if hub != last:
                        last, own = hub, shingles(hub_text, width)
                    other = shingles(text, width)
                    delta = np.setxor1d(own, other, assume_unique=True).view("<i8")
                    out.append((hub, cid, len(own), len(other), delta))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), kinds)], names=names)

    names = ["hub", "cid", "n_hub", "n", "delta"]
    return both.mapInArrow(differ, "hub long, cid long, n_hub long, n long, delta array<long>")


def _hubs(open_: DataFrame) -> DataFrame:
    """(bucket, hub): a class of `open_` to compare the bucket's members with.

    At first that is the member that meets most others. Each class then names the hub that meets
    most of those it meets, and a bucket takes the one that at least half of its members name, be it
    a member or not. So a class in many buckets of one group meets one hub, not one per bucket.
    """
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    central = open_.join(sizes, "bucket").groupBy("cid").agg(F.sum("k").alias("met"))
    hub = F.min(F.struct((-F.col("met")).alias("less"), "cid"))["cid"].alias("hub")
    own = stored(open_.select("bucket", "cid").join(central, "cid").groupBy("bucket").agg(hub))
    met = stored(open_.join(own, "bucket").select("hub", "cid").distinct())
    sizes = met.groupBy("hub").agg(F.count(F.lit(1)).alias("k"))
    named = met.join(sizes, "hub").groupBy("cid").agg(F.max(F.struct("k", "hub"))["hub"].alias("named"))
    votes = open_.select("bucket", "cid").join(named, "cid").groupBy("bucket", "named").agg(F.count(F.lit(1)).alias("k"))
    most = votes.groupBy("bucket").agg(F.max(F.struct("k", "named")).alias("most"), F.sum("k").alias("k"))
    hub = F.when(2 * F.col("most.k") >= F.col("k"), F.col("most.named")).otherwise(F.col("hub")).alias("hub")
    return own.join(most, "bucket").select("bucket", hub)


def _by_deltas(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members to the hubs of their buckets, and all other pairs (a, b) that may be links between components.

    Members are told from one
    another by what they differ in from their hub: x and y differ in exactly those shingles that are
    in one of their deltas only. With p percent and q = (100 - p) / (100 + p), they are linked if they
    differ in at most q (|x| + |y|). A member that is not linked to the hub has a delta over
    q (|x| + |hub|), so by the triangle inequality it shares at least one shingle of its delta
    with any member it is linked to, and

        2 |dx & dy| >= |dx| + |dy| - q (|x| + |y|).

    Deltas are sorted by how many deltas of the hub hold a shingle, rarest first. Two that share
    c shingles share one of the first |d| - c + 1 of each, and the first one they share leaves
    at least c from there on in both. So members that vary their hub each in their own way never
    meet, however many they are, and no link is lost.
    """
    hubs = _hubs(open_)
    met = stored(open_.join(hubs, "bucket").where("cid <> hub").select("hub", "cid", "comp").distinct())
    more, less = 100 + percent, 100 - percent
    d = F.size("delta").cast("long")
    rows = deltas(met.select("hub", "cid"), texts, width).join(met, ["hub", "cid"])
    rows = stored(rows.withColumns({"d": d, "linked": more * d <= less * (F.col("n") + F.col("n_hub"))}))
    to_hubs = rows.where("linked").select(*ordered(F.col("hub"), F.col("cid")))
    # A hub whose other members are all linked to it, or of one component, leaves no pair.
    left = rows.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("linked").alias("all")).where("lo < hi AND NOT all").select("hub")
    rows = rows.join(left, "hub", "leftsemi")

    each = stored(rows.select("hub", "cid", F.explode("delta").alias("e")))
    frequency = each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("f"))
    sorted_ = each.join(frequency.where("f > 1"), ["hub", "e"]).groupBy("hub", "cid").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("shared"))
    # At least so many shingles of a delta are shared: by a link with one side not linked to the hub; by a link of such a member with one that is.
    half = F.greatest(F.lit(1), F.floor((more * F.col("d") - less * (F.col("n") - F.col("n_hub"))) / F.lit(2 * more)).cast("long") + 1)
    far = F.greatest(F.lit(1), F.ceil(F.col("d") - F.col("n") * less / F.lit(percent)).cast("long"))
    placed = rows.drop("delta").join(sorted_, ["hub", "cid"])
    # Shingles of one delta only come first and take part in no pair.
    placed = placed.withColumns({"alone": F.col("d") - F.size("shared"), "short": F.col("d") - half, "long": F.col("d") - far})
    furthest = F.when(F.col("linked"), F.col("short")).otherwise(F.greatest("short", "long"))
    first = F.slice("shared", 1, F.greatest(F.lit(0), furthest - F.col("alone") + 1).cast("int"))
    placed = placed.select("hub", "cid", "comp", "n", "d", "linked", "alone", "short", "long", F.posexplode(first).alias("i", "s"))
    placed = stored(placed.select("hub", F.col("s.e").alias("e"), "cid", "comp", "n", "d", "linked", (F.col("alone") + F.col("i")).alias("at"), "short", "long"))
    side = lambda x: placed.select("hub", "e", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "comp", "n", "d", "linked", "at", "short", "long")])
    x, y = side("x").where("NOT linked_x"), side("y").where("at_y <= short_y")
    apart = (F.col("comp_x") != F.col("comp_y")) & (F.when(F.col("linked_y"), F.col("at_x") <= F.col("long_x")).otherwise((F.col("at_x") <= F.col("short_x")) & (F.col("cid_x") < F.col("cid_y"))))
    left = F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y"))
    enough = 2 * more * left >= more * (F.col("d_x") + F.col("d_y")) - less * (F.col("n_x") + F.col("n_y"))
    pairs = x.join(y, ["hub", "e"]).where(apart & enough).select(*ordered(F.col("cid_x"), F.col("cid_y"))).distinct()
    return to_hubs, pairs


def near_dedup(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, key: str | None = None) -> DataFrame:
    """One row per document: key, id, n_shingles, component_id, kept; `key` names a column that tells rows apart.

    Documents are linked if their sets of `width`-word shingles overlap in `percent`
    of their union. component_id is the smallest id reachable, the document's own
    included; a NULL id is larger than any, and ties go to the row that came first,
    so exactly one row of a component is kept. Documents without words are linked
    with nothing. An empty table gives an empty result.
    """
    if key is None:
        docs, key = keyed(docs)
    docs = docs.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.col(text).alias("text"))
    rows = signed(docs, F.struct("key", "id"), "text", width)
    rows = rows.select("payload.*", "n", "n_shingles", "sig", "bands", "sketch")
    best = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("n").alias("n"))
    # Equal sets are one class: copies are linked here, however many, and meet others once.
    classes = rows.where("sig IS NOT NULL").groupBy("sig").agg(
        F.min(best).alias("best"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("key").alias("key")
    )
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))
    labels = link(docs, classes, width, percent)
    named = classes.select("sig", "cid", "best").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = stored(named.select("sig", "comp", "best"))
    bests = named.groupBy("comp").agg(F.min("best").alias("best"))
    per_class = named.select("sig", "comp").join(bests, "comp").select("sig", F.col("best").alias("top"))
    own = rows.select("key", "id", "n", "n_shingles", "sig")
    linked = own.where("sig IS NOT NULL").join(per_class, "sig")
    alone = own.where("sig IS NULL").withColumn("top", best)
    out = linked.select("key", "id", "n_shingles", "n", "top").unionByName(alone.select("key", "id", "n_shingles", "n", "top"))
    return out.select("key", "id", "n_shingles", F.col("top.id").alias("component_id"), (F.col("n") == F.col("top.n")).alias("kept"))


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns it came with."""
    docs, key = keyed(docs)
    kept = near_dedup(docs, id_, text, width, percent, key).where("kept").select(F.col("key").alias(key))
    return docs.join(kept, key, "leftsemi").drop(key)
