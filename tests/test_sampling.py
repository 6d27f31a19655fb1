import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators import sampling as A


@pytest.fixture(scope="module")
def imbalanced(spark):
    rng = np.random.default_rng(42)
    rows = [(i, 0, rng.normal(0, 1, 8).tolist()) for i in range(500)]
    rows += [(500 + i, 1, rng.normal(3, 0.5, 8).tolist()) for i in range(50)]
    return spark.createDataFrame(rows, "id bigint, fault int, v array<double>").repartition(4).cache()


def counts(df):
    return {r["fault"]: r["count"] for r in df.groupBy("fault").count().collect()}


@pytest.mark.parametrize("raw, want", [("", "auto"), ("0.5", 0.5), ("1", 1.0), ("0", "auto"), ("1.5", "auto"), ("Minority", "minority"), ("junk", "auto")])
def test_strategy_parsing(raw, want):
    assert A.sampling_strategy(raw) == want


def test_minority_grows_to_majority_and_majority_is_untouched(imbalanced):
    out = A.smote(imbalanced, "v", "fault", "id").cache()
    assert counts(out) == {0: 500, 1: 500}
    kept = out.where("NOT is_synthetic").select("id").collect()
    assert sorted(r["id"] for r in kept) == list(range(550))
    assert out.where("is_synthetic AND fault = 0").isEmpty()
    originals = {r["id"]: np.array(r["v"]) for r in imbalanced.where("fault = 1").collect()}
    for r in out.where("is_synthetic").collect():
        a, b, x = originals[r["parent"]], originals[r["neighbour"]], np.array(r["v"])
        assert (x >= np.minimum(a, b) - 1e-9).all() and (x <= np.maximum(a, b) + 1e-9).all()
        u = (x - a) / (b - a)
        assert np.allclose(u, u[0]) and 0 <= u[0] < 1


def test_ratio_seed_and_errors(imbalanced):
    assert counts(A.smote(imbalanced, "v", "fault", "id", strategy=0.5)) == {0: 500, 1: 250}
    key = lambda seed: sorted(
        str(r["v"]) for r in A.smote(imbalanced, "v", "fault", "id", strategy=0.2, seed=seed).where("is_synthetic").collect()
    )
    assert key(1) == key(1) != key(2)
    with pytest.raises(ValueError):
        A.smote(imbalanced.where("fault = 1"), "v", "fault", "id")
    with pytest.raises(ValueError):
        A.synthetic_counts({0: 500, 1: 300}, 0.5)


def test_borderline_seeds_have_mixed_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, [float(x)]) for i, x in enumerate(rng.uniform(0, 1, 80))]
    rows += [(100 + i, 1, [float(x)]) for i, x in enumerate(rng.uniform(0.9, 2, 40))]
    df = spark.createDataFrame(rows, "id bigint, fault int, v array<double>")
    seeds = {r["id"] for r in A.borderline_seeds(df, "v", "fault", "id", 1).collect()}
    for i, y, v in rows:
        if y == 1:
            near = sorted((round(abs(w[0] - v[0]), 6), j, z) for j, z, w in rows if j != i)[:10]
            foreign = sum(z == 0 for *_, z in near)
            assert (i in seeds) == (5 <= foreign < 10)
    made = A.smote(df, "v", "fault", "id", borderline=True).where("is_synthetic")
    assert {r["parent"] for r in made.collect()} == seeds and made.count() == 40


@pytest.mark.parametrize("target", [10**6, 20])
def test_split_is_exact_disjoint_and_stable(imbalanced, target):
    out = A.stratified_split(imbalanced, "fault", "id", target_rows=target)
    got = {(r["fault"], r["is_test"]): r["count"] for r in out.groupBy("fault", "is_test").count().collect()}
    assert got == {(0, True): 100, (0, False): 400, (1, True): 10, (1, False): 40}
    plain = A.stratified_split(imbalanced, "fault", "id")
    ids = lambda d: sorted(r["id"] for r in d.where("is_test").collect())
    assert ids(out) == ids(plain)


def test_folds(imbalanced):
    out = A.stratified_folds(imbalanced, "fault", "id", 5)
    got = {(r["fold"], r["fault"]): r["count"] for r in out.groupBy("fold", "fault").count().collect()}
    assert set(got.values()) == {100, 10} and len(got) == 10


def test_group_folds_keep_days_whole_and_balanced(spark):
    days = spark.range(1000).select((F.col("id") % 17 * F.col("id") % 13).cast("int").alias("day"))
    folds = A.group_folds(days, "day", 4).collect()
    assert len({r["day"] for r in folds}) == len(folds)
    load = {}
    for r in folds:
        load[r["fold"]] = load.get(r["fold"], 0) + r["n"]
    assert sum(load.values()) == 1000 and max(load.values()) - min(load.values()) <= max(r["n"] for r in folds)
    with pytest.raises(ValueError):
        A.group_folds(days, "day", 50)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_group_folds_are_dealt_as_one_by_one(spark, k):
    """Dealing whole size classes gives what the greedy loop gives, group by group, however sizes repeat."""
    rng = random.Random(k)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 7, 20, 55]) for _ in range(150)]
    rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
    got = {r["g"]: r["fold"] for r in A.group_folds(spark.createDataFrame(rows, "g int"), "g", k).collect()}
    load, want = [0] * k, {}
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], g)):
        fold = load.index(min(load))
        want[g], load[fold] = fold, load[fold] + sizes[g]
    assert got == want
    texts = A.group_folds(spark.createDataFrame(rows, "g int").select(F.col("g").cast("string").alias("g")), "g", k).groupBy("fold").agg(F.sum("n")).collect()
    assert sorted(r[1] for r in texts) == sorted(load)


def test_report(imbalanced):
    after = A.smote(imbalanced, "v", "fault", "id", strategy=0.5)
    got = {r["fault"]: tuple(r) for r in A.resampling_report(imbalanced, after, "fault").collect()}
    assert got == {0: (0, 500, 500, 0), 1: (1, 50, 250, 200)}


@pytest.mark.parametrize("n, want", [(0, 0), (7, 7), (549, 549), (550, 550), (9999, 550)])
def test_sample_sizes(imbalanced, n, want):
    assert A.seeded_sample(imbalanced, "id", n, target_rows=30).count() == want


def test_a_missing_label_is_a_class_of_its_own(imbalanced):
    df = imbalanced.withColumn("fault", F.when(F.col("fault") == 0, 0))
    out = A.stratified_split(df, "fault", "id")
    assert {r["fault"]: r["n"] for r in out.where("is_test").groupBy("fault").agg(F.count("*").alias("n")).collect()} == {0: 100, None: 10}


@pytest.mark.parametrize("target", [None, 40])
def test_folds_keep_rows_without_label(imbalanced, target):
    """Small and cut classes give the same folds, and no row without a label is lost."""
    from faultlens.plans.ranking import rank_in_class

    df = imbalanced.withColumn("fault", F.when(F.col("fault") == 0, 0))
    got = rank_in_class(df, "fault", "id", target_rows=target).select("id", "fault", "rank", "class_rows")
    want = rank_in_class(df, "fault", "id").select("id", "fault", "rank", "class_rows")
    assert got.count() == df.count() and got.exceptAll(want).isEmpty()


def test_split_leak_check_covers_the_whole_table(spark, events):
    """The registered query counts what plain Python finds in all events."""
    from hashlib import md5

    from __spark_entry__ import oracle_sql, queries
    from conftest import SMALL

    assert "split_leak_check" in oracle_sql()
    classes = {0: [], 1: []}
    for r in events.select("event_id", "event_type", "value").collect():
        classes[int(r["event_type"] == "error")].append((md5(f"42:{r['event_id']}".encode()).hexdigest(), r["event_id"], r["value"]))
    want = 0
    for part in classes.values():
        n_test = int(len(part) * 0.2 + 0.5)
        values = [v for *_, v in sorted(part)]
        want += sum(v in set(values[n_test:]) for v in values[:n_test])
    assert [r["n_leaked"] for r in queries()["split_leak_check"](spark, SMALL).collect()] == [want]
