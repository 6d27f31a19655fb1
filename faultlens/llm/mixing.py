"""Mixing sources to target weights by pivotal dependent rounding of fractional copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.llm.common import count_words, fresh, join_groups, keyed, stored
from faultlens.plans.series import lay_out

MOST_COPIES = 3
BLOCK = 512
# Fractional copies are kept as whole units of 1 / UNIT word, so no mass is lost in rounding.
UNIT = 1 << 20


def weigh_sources(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """`target` for each row (source, source_size): shares by weight, none above `most` times its size.

    Weights repeat over the sources by code point, NULL last. Let c = most * size and
    t = min(c, level * weight). Sorted by c / weight, the level follows from running
    sums. The table has one row per source name, so one ordered window is enough.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.withColumn("w", F.get(pattern, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size").cast("double"))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, W.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(W.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levelled = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    chosen = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "level"))).over(W.partitionBy())["level"]
    return levelled.withColumn("target", F.least(F.col("cap"), F.coalesce(chosen, F.lit(0.0)) * F.col("w"))).select("source", "source_size", "n", "target")


def _meet(state: Column, x: Column, seed: int) -> Column:
    """One pivotal step: the open document of `state` and `x` trade mass until one of them is decided.

    a gives to b or b to a, with odds that leave the expected mass of both as it was.
    """
    a = state["open"]
    room_a, room_b = a["size"] - a["mass"], x["size"] - x["mass"]
    up, down = F.least(room_a, x["mass"]), F.least(a["mass"], room_b)
    draw = F.pmod(F.xxhash64(a["lot"], x["lot"], F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    rises = draw * (up + down).cast("double") < down.cast("double")
    moved = F.when(rises, up).otherwise(-down)

    def with_mass(d: Column, mass: Column) -> Column:
        return F.struct(d["n"].alias("n"), d["size"].alias("size"), mass.alias("mass"), d["lot"].alias("lot"))

    def over(d: Column) -> Column:
        return (d["mass"] == 0) | (d["mass"] == d["size"])

    def settle(pair: Column) -> Column:
        one, two = pair["a"], pair["b"]
        none = F.lit(None).cast("struct<n:bigint,size:bigint,mass:bigint,lot:bigint>")
        is_open = F.when(~over(one), one).when(~over(two), two).otherwise(none)
        ended = F.filter(F.array(one, two), over)
        return F.struct(is_open.alias("open"), F.concat(state["done"], F.transform(ended, _outcome)).alias("done"))

    pair = F.struct(with_mass(a, a["mass"] + moved).alias("a"), with_mass(x, x["mass"] - moved).alias("b"))
    met = F.get(F.transform(F.array(pair), settle), F.lit(0))
    alone = F.struct(with_mass(x, x["mass"]).alias("open"), state["done"].alias("done"))
    return F.when(a.isNull(), alone).otherwise(met)


def _outcome(d: Column) -> Column:
    return F.struct(d["n"].alias("n"), (d["mass"] > 0).alias("up"))


def round_copies(fractions: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(n, up) for rows (source, n, lot, size, mass) with 0 < mass < size; `up` gives one more copy.

    Blocks, order and draws follow the lots alone; n only names the row.

    Blocks of about `block` documents of a source are settled in parallel, larger
    documents first, so that what stays open tends to be small, and pass on at most
    one open document each; `block` of those make up a block of the next level. Each
    level is stored, so a lost executor repeats at most one level. The last open
    document of a source goes to the nearer side.
    """
    sizes = fractions.groupBy("source").agg(F.count(F.lit(1)).alias("k"))
    blocks = sizes.select(F.col("source").alias("b_source"), F.ceil(F.col("k") / block).cast("long").alias("blocks"))
    most = blocks.agg(F.max("blocks")).first()[0]
    doc = F.struct("n", "size", "mass", "lot")
    empty = F.struct(
        F.lit(None).cast("struct<n:bigint,size:bigint,mass:bigint,lot:bigint>").alias("open"),
        F.array().cast("array<struct<n:bigint,up:boolean>>").alias("done"),
    )
    level = fractions.join(blocks, F.col("source").eqNullSafe(F.col("b_source"))).select(
        "source", F.pmod(F.xxhash64("lot"), F.col("blocks")).alias("b"), doc.alias("d")
    )
    outcomes, depth, left = [], 0, most or 1
    while True:
        order = F.array_sort(F.collect_list(F.struct((-F.col("d.size")).alias("s"), F.col("d.lot").alias("h"), "d")))
        docs = F.transform(order, lambda x: x["d"])
        state = F.aggregate(docs, empty, lambda s, x: _meet(s, x, seed + depth))
        settled = stored(level.groupBy("source", "b").agg(state.alias("s")))
        outcomes.append(settled.select(F.explode("s.done").alias("o")).select("o.n", "o.up"))
        opened = settled.where("s.open IS NOT NULL")
        if left <= 1:
            o = F.col("s.open")
            outcomes.append(opened.select(o["n"].alias("n"), (2 * o["mass"] > o["size"]).alias("up")))
            break
        level = opened.select("source", F.floor(F.col("b") / block).alias("b"), F.col("s.open").alias("d"))
        depth, left = depth + 1, -(-left // block)
    out = outcomes[0]
    for o in outcomes[1:]:
        out = out.unionByName(o)
    return out


def content(docs: DataFrame) -> list[Column]:
    """The columns of `docs` that Spark can hash: all but maps and variants."""
    return [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def with_lots(rows: DataFrame) -> DataFrame:
    """`rows` (n, h1, h2) with `lot`, a hash of the row's content and, among repeated rows, of its place.

    Repeated rows are like one another, so it does not matter which of them comes first.
    Their places are counted in cells (`lay_out`), so one row may be repeated any number of times.
    """
    groups = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    groups = stored(groups)
    if groups.isEmpty():
        return rows.withColumn("lot", F.xxhash64("h1", "h2", F.lit(1).cast("long")))
    again = join_groups(rows.select("h1", "h2", "n"), groups, ["h1", "h2"], "k")
    places = lay_out(again, ("h1", "h2"), ("n",)).index("place").rows.select("n", "place")
    placed = rows.join(places, "n", "left").withColumn("place", F.coalesce("place", F.lit(1)).cast("long"))
    return placed.withColumn("lot", F.xxhash64("h1", "h2", "place")).drop("place")


def mix(
    docs: DataFrame,
    payload: Column,
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = MOST_COPIES,
    seed: int = 0,
    block: int = BLOCK,
    identity: list[Column] | None = None,
) -> DataFrame:
    """One row per document: payload, size, source_size, target and copies (0 to `most`).

    A document's expected copies are target / source size; the whole part is given,
    the rest rounded so that a source's total words miss its target by less than one
    document. Documents without words get the whole part. Same rows, same seed, same
    result, however the rows are split into files and tasks: draws follow a hash of the row's
    content, the columns `identity` (all that can be hashed). NULL is a source of its own; an empty table gives an empty result.
    """
    identity = content(docs) if identity is None else identity
    own = [F.xxhash64(F.lit(x), *identity).alias(h) for x, h in enumerate(("h1", "h2"))]
    narrow = docs.select(payload.alias("payload"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), *own)
    rows = stored(with_lots(stored(narrow.withColumn("n", F.monotonically_increasing_id()))).drop("h1", "h2"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = stored(weigh_sources(sources, weights, most).drop("n"))
    t = targets.withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)).cast("double"))
    # A hot source meets one row here; AQE splits it or the small side is broadcast.
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("rate", F.least(rate, F.lit(float(most))))
    joined = joined.withColumn("whole", F.floor("rate").cast("long"))
    units = F.col("size") * UNIT
    mass = F.round((F.col("rate") - F.col("whole")) * units).cast("long")
    parts = joined.select("source", "n", "lot", units.alias("size"), mass.alias("mass")).where("mass > 0 AND mass < size")
    ups = round_copies(parts, seed, block)
    all_up = (F.col("size") > 0) & (mass >= units)
    up = F.when(F.coalesce(F.col("up"), F.lit(False)) | all_up, 1).otherwise(0)
    return joined.join(ups, "n", "left").select("payload", "source", "size", "source_size", "target", (F.col("whole") + up).alias("copies"))


def take_mix(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as it was taken, with the columns it came with."""
    identity = content(docs)
    docs, key = keyed(docs)
    copies = fresh(docs, "_copies")
    taken = mix(docs, F.col(key), text, source, identity=identity, **options).where("copies > 0")
    taken = taken.select(F.col("payload").alias(key), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(copies))
    return docs.join(taken, key).withColumn(copies, F.explode(copies)).drop(key, copies)
