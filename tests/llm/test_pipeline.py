"""The pipeline's stages on the given documents: each decision against plain Python, and its columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from faultlens.llm.common import stored
from llm_helpers import SCHEMA, frame, odd_rows, with_clashes
from test_rules_and_copies import dedup_by_hand, measures, targets_by_hand
from test_text_operators import check_packing, near_by_hand


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SMALL))
    return [*out, docs]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_quality(steps):
    kept = {d for d, _ in pairs(steps[1])}
    for d, text in pairs(steps[0]):
        n, _, symbols, _, again = measures(text)
        if n < 50 or 100 * again > 50 * n or symbols > 0.2 * n:
            assert d not in kept


def test_quality_keeps_good_labels(spark, steps):
    """No labelled good document that passes the base limits is lost."""
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    kept = {d for d, _ in pairs(steps[1])}
    for d, text in pairs(steps[0]):
        n, _, _, _, again = measures(text)
        if d in good and n >= 50 and 100 * again <= 50 * n:
            assert d in kept


def test_exact(steps):
    _, best = dedup_by_hand(pairs(steps[1]))
    assert sorted(d for d, _ in pairs(steps[2])) == sorted(r[0] for r in best.values())


def test_near(steps):
    want, _ = near_by_hand(pairs(steps[2]))
    assert sorted(d for d, _ in pairs(steps[3])) == sorted(d for d, _, c in want if d == c)


def test_mix(steps):
    sizes, longest, taken = {}, {}, {}
    for r in steps[3].collect():
        n = measures(r.text)[0]
        sizes[r.source] = sizes.get(r.source, 0) + n
        longest[r.source] = max(longest.get(r.source, 0), n)
    for r in steps[4].collect():
        taken[r.source] = taken.get(r.source, 0) + measures(r.text)[0]
    for s, target in targets_by_hand(sizes).items():
        assert abs(taken.get(s, 0) - target) <= longest[s]
    assert steps[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_packed(steps):
    rows = steps[5].withColumnRenamed("doc_id", "payload").collect()
    copies = {}
    for d, text in pairs(steps[4]):
        copies.setdefault(d, []).append(text)
    first = {}
    for r in rows:
        first.setdefault((r.payload, r.piece), []).append(r)
    assert all(len(v) == len(copies[d]) for (d, _), v in first.items()) and {d for d, _ in first} == set(copies)
    used = len({r.sequence_id for r in rows})
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(spark):
    docs = stored(with_clashes(frame(spark, odd_rows())))
    empty = stored(spark.createDataFrame([], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
        out = stage(spark, docs, SMALL)
        # The odd rows repeat themselves or are short; no rule keeps one.
        assert (out.count() > 0) == (name != "quality_rules")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
