"""Quality rules, exact dedup and mixing against plain Python, on awkward and on given rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from faultlens.llm import exact_dedup, mixing, quality
from llm_helpers import LONG, SCHEMA, WORD, frame, odd_rows, parquet, with_clashes


def measures(text):
    w = WORD.findall(text or "")
    grams = list(zip(w, w[1:], w[2:]))
    twice = {g for g, k in Counter(grams).items() if k > 1}
    cover = {p + k for p, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_measures(spark):
    rows = odd_rows() + [(20, "a b a b a b", "", "", 0), (21, "x x x x", "", "", 0), (22, "p q r s p q r t q r s", "", "", 0), (23, LONG + " " + LONG, "", "", 0)]
    docs = frame(spark, rows)
    got = quality.judge(docs).select("own.text", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed").collect()
    assert len(got) == len(rows)
    for r in got:
        want = measures(r.text)
        assert tuple(r)[1:6] == want, (r.text or "")[:50]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_keep_columns_and_rows(spark):
    text = " ".join(f"the word{i} of thing{i} in" for i in range(15))
    rows = [(1, text, "en", "a", 1), (2, text.replace(" ", " $$ "), "en", "a", 1), (3, text.upper(), "en", None, 1), (4, "zig zag " * 40, "en", "a", 1)]
    docs = with_clashes(frame(spark, rows + odd_rows()))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 3} <= ids and not {2, 4} & ids
    assert quality.keep_good(docs.limit(0)).count() == 0


def same(text):
    return "".join(WORD.findall(text or ""))


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[same(r[1])].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    return groups, best


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup(spark, fan_in, monkeypatch):
    monkeypatch.setattr(exact_dedup.merge_runs, "__defaults__", (fan_in,))
    rows = odd_rows() + [(100 + i, "hot  text" + " " * (i % 3), "en", "a", 1) for i in range(200)]
    docs = frame(spark, rows, parts=7)
    groups, best = dedup_by_hand(rows)
    got = exact_dedup.dedup(docs, F.struct("doc_id", "text")).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        s = same(r.payload.text)
        assert (r.keep_id, r.group_size, bytes(r.digest)) == (best[s][0], len(groups[s]), hashlib.sha256(s.encode()).digest())
        kept[s] += r.kept
        assert not r.kept or (r.id, len(r.payload.text or "")) == (best[s][0], len(best[s][1] or ""))
    assert set(kept.values()) == {1}


def test_exact_dedup_stage(spark, tmp_path):
    docs = parquet(with_clashes(frame(spark, odd_rows())), tmp_path / "d")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(dedup_by_hand(odd_rows())[0])
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0
    assert exact_dedup.keep_first(docs.orderBy("doc_id")).count() == kept.count()


def targets_by_hand(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def check_mix(spark, docs, **options):
    got = mixing.mix(docs, F.col("doc_id"), **options).collect()
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        longest[r.source] = max(longest[r.source], r["size"])
        assert 0 <= r.copies <= 3
    want = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    return got


def test_mix_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, two = (sorted(map(tuple, check_mix(spark, docs))) for _ in range(2))
    assert one == two and len(one) == docs.count()


@pytest.mark.parametrize("block", [2, 8])
def test_mix_small_blocks_and_hot_source(spark, block):
    rows = [(i, "w " * (i % 17 + 1), "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(600)]
    check_mix(spark, frame(spark, rows + odd_rows()), block=block)


def test_mix_keeps_expected_copies(spark):
    """Over many seeds a document is taken as often as its share says."""
    rows = [(i, "w " * (10 + i), "en", s, 1) for i in range(4) for s in ("a", "b", "c")]
    docs = frame(spark, rows).cache()
    total, runs = Counter(), 30
    for seed in range(runs):
        for r in mixing.mix(docs, F.col("doc_id"), seed=seed * 100, block=4).collect():
            total[r.source] += r.copies
    # a: 1/6 of the words, 0.5 copies each; b: 1; c: 1.5.
    assert abs(total["a"] / runs / 4 - 0.5) < 0.12 and total["b"] == 4 * runs and abs(total["c"] / runs / 4 - 1.5) < 0.12


def test_mix_stage(spark, tmp_path):
    docs = parquet(with_clashes(frame(spark, odd_rows())), tmp_path / "d")
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty, F.col("doc_id")).count() == 0 and mixing.take_mix(empty).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "", "a", 0), (2, " ", "", "a", 0)]), F.col("doc_id")).agg(F.sum("copies")).first()[0] == 0


@pytest.mark.parametrize("block", [512, 8])
def test_mix_does_not_follow_files_and_tasks(spark, tmp_path, block):
    """One table in one file, in many, and shuffled: each row gets as many copies."""
    rows = odd_rows() * 3 + [(100 + i, f"some words {'of a text ' * (i % 9)}", "en", "abc"[i % 3], i) for i in range(300)] + [(7, "again and again", "en", "a", 1)] * 40
    frames = [frame(spark, rows, parts=1), parquet(frame(spark, rows[::-1], parts=9), tmp_path / "many"), frame(spark, random.Random(3).sample(rows, len(rows)), parts=4)]
    mixes = [sorted(map(tuple, mixing.mix(f, F.col("doc_id"), block=block).collect()), key=repr) for f in frames]
    assert mixes[0] == mixes[1] == mixes[2]
    taken = [sorted(map(tuple, mixing.take_mix(f, block=block).collect()), key=repr) for f in frames]
    assert taken[0] == taken[1] == taken[2]
