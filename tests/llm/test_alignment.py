"""Alignment of two tokenizers against plain Python on the tokenizers' own files."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from faultlens.llm import alignment
from faultlens.llm.queries import QUERIES
from llm_helpers import SCHEMA, frame, odd_rows, with_clashes

FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
UNWRITTEN = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
ODD = [
    "a▁b c", "▁", "<0x41> <unk> <s>", "say <|endoftext|> and <|endoftext|>", "tabs\t\tand \n\n lines  end ", "  ", " x", "\x00\x1f", "ｆｕｌｌ ①②", "é é",
    "it's we'll 1234567890 !!??", "https://example.org/a?b=c&d", "日本語 テスト 한국어 عربى", "👩‍👩‍👧 flags 🇩🇪", "a" * 3000, "  wide", "\r\n\r\n",
]


@pytest.fixture(scope="module")
def plain():
    """The bytes and ids of both vocabularies, read from the files that the contract names."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])

    def run(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(UNWRITTEN[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
        whole = b" " + text.encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        ends = [np.cumsum(list(map(len, x))).tolist() for x in (bytes_a, bytes_b)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        return groups

    return run


def expected(rows, plain):
    groups = [plain(t) for _, t in rows]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for (d, _), g in zip(rows, groups):
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), text))
    return sorted(out, key=repr)


def digested(rows):
    return sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in rows), key=repr)


def test_odd_texts(spark, plain):
    rows = [r[:2] for r in odd_rows() if r[0] != 6] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = with_clashes(frame(spark, [(d, t, "en", "a", 1) for d, t in rows], parts=4))
    got = alignment.align(docs, F.col("doc_id"), *FILES)
    names = ["payload", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == expected(rows, plain)


def test_query(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_cross_tokenizer_alignment"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == digested(expected(rows, plain))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), F.col("doc_id"), *FILES).count() == 0


def test_pair_counts(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = alignment.pair_counts(frame(spark, [(d, t, "en", "a", 1) for d, t in rows]), *FILES).collect()
    want = Counter((a[-1], b[-1]) for _, t in rows for a, b in plain(t))
    assert {(r.a_id, r.b_id): r.links for r in got} == want


def test_merge_paths_are_even_and_whole():
    rng = random.Random(5)
    for _ in range(50):
        a, b = (np.array(sorted(rng.sample(range(400), rng.randrange(1, 200)))) for _ in range(2))
        size = rng.randrange(1, 40)
        at_a, at_b = alignment.diagonals(a, b, size)
        assert (np.diff(at_a + at_b)[:-1] == size).all() and (at_a[-1], at_b[-1]) == (len(a), len(b))
        x, y = alignment.overlaps(a, b, size)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a) & set(b))
