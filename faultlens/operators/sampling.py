"""Splits, folds, class weights and synthetic oversampling."""

from __future__ import annotations

import os
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.operators.knn import nearest
from faultlens.plans.bounded import small
from faultlens.plans.ranking import flag_lowest, rank_in_class, seeded_hash, seeded_unit
from faultlens.plans.series import lay_out
from faultlens.session import cut

# Names of the oversampling strategies and the setting that picks one.
STRATEGIES = ("auto", "minority", "not minority", "not majority", "all")
STRATEGY_SETTING = "SMOTE_SAMPLING_STRATEGY"
COPIES_PER_TASK = 10_000


def sampling_strategy(raw: str | None = None) -> str | float:
    """A ratio in (0, 1], a strategy name, or `auto` for anything else."""
    text = (os.environ.get(STRATEGY_SETTING, "") if raw is None else raw).strip()
    try:
        ratio = float(text)
    except ValueError:
        return text.lower() if text.lower() in STRATEGIES else "auto"
    return ratio if 0 < ratio <= 1 else "auto"


def stratified_split(
    df: DataFrame,
    label: str,
    ids: str,
    test_size: float = 0.2,
    seed: int = 42,
    stratify: bool = True,
    target_rows: int | None = None,
) -> DataFrame:
    """Add `is_test`: per class exactly round(test_size * n) rows, chosen by seeded hash."""
    by = label if stratify else "_one"
    rows = df if stratify else df.withColumn("_one", F.lit(0))
    # floor(x + 0.5) rounds halves up in every engine.
    quota = F.floor(F.col("class_rows") * test_size + 0.5)
    return flag_lowest(rows, by, ids, quota, "is_test", seed, target_rows).drop("_one")


def seeded_sample(
    df: DataFrame, ids: str, n: int, seed: int = 42, target_rows: int | None = None
) -> DataFrame:
    """Exactly `n` rows without replacement (all rows if there are fewer)."""
    rows = df.withColumn("_one", F.lit(0))
    picked = flag_lowest(rows, "_one", ids, F.lit(n).cast("bigint"), "_in", seed, target_rows)
    return picked.where("_in").drop("_in", "_one")


def nested_validation(
    df: DataFrame, label: str, ids: str, size: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add `is_validation` inside a training set, for early stopping."""
    return stratified_split(df, label, ids, size, seed).withColumnRenamed("is_test", "is_validation")


def stratified_folds(
    df: DataFrame, label: str, ids: str, k: int = 5, seed: int = 42, target_rows: int | None = None
) -> DataFrame:
    """Add `fold` in 0..k-1: class shares are equal up to one row per fold."""
    ranked = rank_in_class(df, label, ids, seed, target_rows=target_rows)
    return ranked.withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("rank", "class_rows")


def _deal(loads: list[int], size: int, groups: int) -> list[tuple[int, list[int]]]:
    """Where greedy dealing of `groups` groups of one size goes, as (first rank, folds in turn); adds them to `loads`.

    Fold f is the lightest again and again at loads f + j * size, so the picks are the merge
    of one such ladder per fold. Between the starts of two ladders the same folds take turns.
    """
    starts = sorted((load, f) for f, load in enumerate(loads))

    def picks_below(load: int) -> int:
        return sum(-(-(load - own) // size) for own in loads if own < load)

    plan = []
    for i in range(len(starts)):
        level = starts[i][0]
        if i + 1 < len(starts) and starts[i + 1][0] == level:
            continue
        first = picks_below(level)
        if first >= groups:
            break
        turns = sorted((own + -(-(level - own) // size) * size, f) for own, f in starts[: i + 1])
        plan.append((first, [f for _, f in turns]))
    for (first, turns), end in zip(plan, [p[0] for p in plan[1:]] + [groups]):
        for place, f in enumerate(turns):
            loads[f] += size * len(range(first + place, min(end, groups), len(turns)))
    return plan


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold of each group: largest group first, always into the lightest fold.

    Groups of one size are dealt by their rank among them, in the order of the group's
    value (of its hash where that is no number or time). The driver sees one row per size, and there
    are at most sqrt(2 n) sizes in n rows.
    """
    sizes = cut(df.groupBy(group).agg(F.count("*").alias("n")))
    classes = sizes.groupBy("n").count().orderBy(F.desc("n")).collect()
    found = sum(c["count"] for c in classes)
    if found < k:
        raise ValueError(f"{k} folds need at least {k} groups, found {found}")
    loads, rows = [0] * k, []
    for c in classes:
        rows.append((c["n"], [{"first": first, "turns": turns} for first, turns in _deal(loads, c["n"], c["count"])]))
    plans = df.sparkSession.createDataFrame(rows, "n bigint, plan array<struct<first:bigint,turns:array<int>>>")
    ordered = isinstance(sizes.schema[group].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.IntegralType))
    named = sizes.withColumn("_order", F.col(group) if ordered else F.xxhash64(group)).withColumn("_size", F.col("n"))
    ranked = lay_out(named, "_size", ("_order",)).index("_rank", start=0).rows
    part = F.element_at(F.filter("plan", lambda p: p["first"] <= F.col("_rank")), -1)
    fold = F.get(part["turns"], F.pmod(F.col("_rank") - part["first"], F.size(part["turns"])).cast("int"))
    return ranked.join(small(plans), "n").select(group, fold.alias("fold"), "n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class n / (classes * n_class), and the negative-to-positive ratio."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    t = counts.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("neg"),
        F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("pos"),
    ).first()
    ratio = (t["neg"] or 0) / max(1, t["pos"] or 0)
    return counts.select(
        label,
        "n",
        F.round(F.lit(float(t["n"] or 0)) / (F.lit(t["k"]) * F.col("n")), 6).alias("balanced_weight"),
        F.round(F.lit(ratio), 4).alias("pos_weight"),
    )


def _class_sizes(df: DataFrame, label: str) -> dict:
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    if len(sizes) < 2:
        raise ValueError(f"oversampling needs at least 2 classes, found {len(sizes)}")
    return sizes


def synthetic_counts(sizes: dict, strategy: str | float = "auto") -> dict:
    """How many synthetic rows each class gets."""
    top = max(sizes.values())
    ordered = sorted(sizes, key=lambda c: (sizes[c], str(c)))
    smallest, largest = ordered[0], ordered[-1]
    if isinstance(strategy, float):
        if len(sizes) != 2:
            raise ValueError("a ratio needs exactly 2 classes")
        want = int(top * strategy)
        if want < sizes[smallest]:
            raise ValueError("the ratio would shrink the minority class")
        return {smallest: want - sizes[smallest]}
    chosen = {
        "auto": [c for c in ordered if c != largest],
        "not majority": [c for c in ordered if c != largest],
        "minority": [smallest],
        "not minority": [c for c in ordered if c != smallest],
        "all": ordered,
    }[strategy]
    return {c: top - sizes[c] for c in chosen}


def smote(
    df: DataFrame,
    vector: str,
    label: str,
    ids: str,
    strategy: str | float = "auto",
    k: int = 5,
    seed: int = 42,
    borderline: bool = False,
    m: int = 10,
    target_rows: int | None = None,
) -> DataFrame:
    """Original rows plus synthetic ones (`is_synthetic`, `parent`, `copy`).

    Each seed row makes quotient-or-remainder many new rows; copy j lies on the
    segment to neighbour j mod k at a seeded fraction. The borderline variant seeds
    only from minority rows whose surroundings are mostly, but not only, foreign.
    """
    out = df.select(
        ids,
        label,
        F.transform(vector, lambda v: v.cast("double")).alias(vector),
        F.lit(False).alias("is_synthetic"),
        F.lit(None).cast("bigint").alias("parent"),
        F.lit(None).cast("bigint").alias("neighbour"),
        F.lit(None).cast("int").alias("copy"),
    )
    sizes = _class_sizes(df, label)
    for value, n in synthetic_counts(sizes, strategy).items():
        if n > 0:
            if sizes[value] <= k:
                raise ValueError(f"class {value!r} has {sizes[value]} rows; {k} neighbours need {k + 1}")
            made = synthetic_rows(df, vector, label, ids, value, n, k, seed, borderline, m, target_rows)
            out = out.unionByName(made)
    return out


def synthetic_rows(
    df: DataFrame,
    vector: str,
    label: str,
    ids: str,
    value,
    n: int,
    k: int = 5,
    seed: int = 42,
    borderline: bool = False,
    m: int = 10,
    target_rows: int | None = None,
) -> DataFrame:
    """`n` synthetic rows of class `value` from its `k` nearest neighbours."""
    # Searched, and joined to both ends of the new rows: what makes the rows runs once.
    minority = cut(df.where(F.col(label) == value).select(ids, vector))
    pairs = nearest(minority, minority, ids, vector, k, target_rows=target_rows)
    if borderline:
        seeds = borderline_seeds(df, vector, label, ids, value, m, target_rows)
        seeds = cut(seeds.select(F.col(ids).alias("id")))
        if seeds.isEmpty():
            warnings.warn(f"no row of class {value!r} lies at the border; it gets no synthetic rows", stacklevel=3)
        pairs = pairs.join(seeds, "id", "left_semi")
    # The ranking below reads this several times; the search is done once.
    neighbours = cut(pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "neighbour"))).alias("_near")))
    seeds = neighbours.withColumn("_one", F.lit(0))
    ranked = rank_in_class(seeds, "_one", "id", seed, target_rows=target_rows)
    # Every seed makes total div seeds copies, the first (total mod seeds) one more.
    share = F.floor(F.lit(n) / F.col("class_rows")) + (
        F.col("rank") < F.pmod(F.lit(n), F.col("class_rows"))
    ).cast("int")
    copies = (
        ranked.withColumn("_share", share.cast("int"))
        .where(F.col("_share") > 0)
        # A seed of many copies is dealt to several tasks before they are made.
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_share") - 1) / COPIES_PER_TASK))))
        .repartition("id", "_block")
        .withColumn("copy", F.explode(_copies_of_block(F.col("_block"), F.col("_share"))))
        .drop("_block")
    )
    near = F.element_at("_near", F.pmod(F.col("copy"), F.size("_near")) + 1)["neighbour"]
    plan = copies.select(
        F.col("id").alias("parent"),
        near.alias("neighbour"),
        "copy",
        seeded_unit(seeded_hash(seed, "id", "copy")).alias("_u"),
    )
    points = minority.select(ids, F.transform(vector, lambda v: v.cast("double")).alias("_v"))
    a = points.select(F.col(ids).alias("parent"), F.col("_v").alias("_a"))
    b = points.select(F.col(ids).alias("neighbour"), F.col("_v").alias("_b"))
    joined = plan.join(a, "parent").join(b, "neighbour")
    mixed = F.zip_with("_a", "_b", lambda x, y: x + F.col("_u") * (y - x))
    return joined.select(
        F.lit(None).cast(df.schema[ids].dataType).alias(ids),
        F.lit(value).cast(df.schema[label].dataType).alias(label),
        mixed.alias(vector),
        F.lit(True).alias("is_synthetic"),
        "parent",
        "neighbour",
        "copy",
    )


def _copies_of_block(block: Column, share: Column) -> Column:
    first = (block * COPIES_PER_TASK).cast("int")
    return F.sequence(first, F.least(first + COPIES_PER_TASK, share) - 1)


def borderline_seeds(
    df: DataFrame,
    vector: str,
    label: str,
    ids: str,
    value,
    m: int = 10,
    target_rows: int | None = None,
) -> DataFrame:
    """Minority rows with at least half, but not all, of `m` neighbours of another class."""
    minority = df.where(F.col(label) == value)
    pairs = nearest(minority, df, ids, vector, m, target_rows=target_rows)
    classes = df.select(F.col(ids).alias("neighbour"), F.col(label).alias("_class"))
    foreign = F.count_if(F.col("_class") != value)
    return (
        pairs.join(classes, "neighbour")
        .groupBy("id")
        .agg(foreign.alias("n_foreign"), F.count("*").alias("n_near"))
        .where((F.col("n_foreign") * 2 >= F.col("n_near")) & (F.col("n_foreign") < F.col("n_near")))
        .withColumnRenamed("id", ids)
    )


def resampling_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after, and how many are synthetic."""
    b = before.groupBy(label).agg(F.count("*").alias("before"))
    a = after.groupBy(label).agg(F.count("*").alias("after"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return b.join(a, label, "full").select(
        label, n("before").alias("before"), n("after").alias("after"), (n("after") - n("before")).alias("synthetic")
    )


def content_key(columns: Sequence[str] | Column) -> Column:
    """128 bits of the row content, cheap to shuffle; equal keys are verified by value."""
    if isinstance(columns, Column):
        columns = [columns]
    parts = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    return F.array(*parts)


def leaked_rows(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test rows whose exact content also occurs in the training split."""
    key = content_key([F.col(c) for c in columns])
    seen = train.select(key.alias("_k"), *[F.col(c).alias(f"_t_{c}") for c in columns]).dropDuplicates()
    same = F.col("_k") == F.col("_k2")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return test.withColumn("_k2", key).join(seen, same, "left_semi").drop("_k2")
