"""Phrase collocations against plain Python, by tries and by shuffle, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from faultlens.llm import collocations, sql
from faultlens.llm.queries import QUERIES
from llm_helpers import LOWER, SCHEMA, frame, odd_rows, with_clashes

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, least, longest=4, share=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = defaultdict(int)
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                longer[q] = max(longer[q], a)
    out = defaultdict(list)
    for p, a in found.items():
        if 100 * longer[p] >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        phrase = " ".join(p[1:])
        out[p[0]].append((-score, -a, phrase.encode(), phrase, left, right))
    return sorted((lang, i, p, -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, _, p, x, y) in enumerate(sorted(v)[:top], 1))


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "new", "york", "city", "é", "日本", "x\x1cy", "a b", "don't", "$5", "Ab", "ab"]
    fixed = ["new york city hall", "the of the of the", "ab ab ab ab ab", "one two three four five", "\t tab  two\tspaces "]
    out = []
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(40)]
        out.append((100 + i, "".join(p + rng.choice([" ", "  ", "\t", ". ", "\n", ", ", " "]) for p in parts), rng.choice(["en", "en", "fr", None]), "a", 1))
    return out


def got(df):
    assert df.columns == NAMES and all(t == "bigint" for c, t in df.dtypes if c not in ("lang", "phrase"))
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.mark.parametrize("most_phrases", [4_000_000, 3, -1])
def test_tries_and_shuffle(spark, most_phrases, monkeypatch):
    """Any number of phrases gives the same rows: beyond the bound they are counted by a shuffle."""
    monkeypatch.setattr(collocations, "MOST_PHRASES", most_phrases)
    rows = odd_rows() + texts(60, 1)
    docs = with_clashes(frame(spark, rows, parts=4))
    assert got(collocations.mine(docs, least=4)) == by_hand([(t, g) for _, t, g, *_ in rows], 4)


@pytest.mark.parametrize("longest", [2, 4, 5])
def test_levels_without_the_driver(spark, longest, monkeypatch):
    """More phrases than a trie may have: filters that are far too full change nothing, and no phrase passes the driver."""
    monkeypatch.setattr(collocations, "MOST_PHRASES", 3)
    monkeypatch.setattr(collocations, "count_by_shuffle", None)
    monkeypatch.setattr(collocations, "MOST_BITS", 256)
    monkeypatch.setattr(collocations, "CHUNK_BITS", 64)
    monkeypatch.setattr(collocations, "HELD_POSITIONS", 500)
    monkeypatch.setattr(collocations.Trie, "add", lambda *_: pytest.fail("built a trie of too many phrases"))
    rows = odd_rows() + texts(60, 4)
    want = by_hand([(t, g) for _, t, g, *_ in rows], 4, longest)
    assert got(collocations.mine(frame(spark, rows, parts=4), least=4, longest=longest)) == want


def test_more_words_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_WORDS", 2)
    rows = odd_rows() + texts(60, 1)
    assert got(collocations.mine(frame(spark, rows, parts=4), least=4)) == by_hand([(t, g) for _, t, g, *_ in rows], 4)


def test_top_and_least(spark):
    rows = texts(80, 2)
    docs = frame(spark, rows)
    assert got(collocations.mine(docs, least=300, top=5, share=60)) == by_hand([(t, g) for _, t, g, *_ in rows], 300, top=5, share=60)


def test_many_words(spark):
    """More words than one symbol has values, and many children to a state."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["of", "to", "in"]) + f" w{rng.randrange(900)} end" for _ in range(600)), "en", "a", 1) for i in range(12)]
    assert got(collocations.mine(frame(spark, rows), least=3)) == by_hand([(t, g) for _, t, g, *_ in rows], 3)


def test_trie():
    rng = np.random.default_rng(7)
    words = 3000
    trie, level, known = collocations.Trie(words), [(i,) for i in range(1, words + 1)], {(i,): i for i in range(1, words + 1)}
    for _ in range(3):
        new = {(*level[rng.integers(len(level)) // rng.integers(1, 50)], int(w)) for w in rng.integers(1, words + 1, 4000)}
        new = sorted(new)
        known.update(zip(new, trie.add(np.array([known[p[:-1]] for p in new]), np.array([p[-1] for p in new])).tolist()))
        level = new
    read = collocations.Trie.of(*trie.arrays())
    assert len(set(known.values())) == len(known)
    for p, s in known.items():
        assert read.states(np.array(p), len(p)).tolist() == [s]
    misses = np.column_stack([rng.integers(0, words + 1, 5000) for _ in range(4)])
    for p in map(tuple, misses.tolist()):
        assert read.states(np.array(p), 4)[0] == known.get(p, 0)
    # Dense enough to broadcast: a few slots per state.
    assert len(read.check) < 4 * len(known)


def test_trie_tells_the_words_of_a_state():
    trie, rng = collocations.Trie(2000), np.random.default_rng(5)
    at, known = np.arange(1, 2001), {(i,): i for i in range(1, 2001)}
    for length in range(2, 5):
        new = sorted({(*p, int(w)) for p, w in zip([p for p in known if len(p) == length - 1], rng.integers(1, 2001, 2000))})
        at = trie.add(np.array([known[p[:-1]] for p in new]), np.array([p[-1] for p in new]))
        known |= dict(zip(new, at.tolist()))
        read = collocations.Trie.of(*trie.arrays())
        assert [*zip(*(w.tolist() for w in read.words(at, length)))] == new and set(read.lengths(at).tolist()) == {length}
    assert read.lengths(np.arange(1, 2001)).tolist() == [1] * 2000


def test_empty(spark):
    assert got(collocations.mine(spark.createDataFrame([], SCHEMA))) == []
    assert got(collocations.mine(frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)]))) == []
    assert got(collocations.mine(frame(spark, [(1, "one two", None, None, None)] * 30))) == [("und", 1, "one two", 30, 30, 30, 60, 1_000_000)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({sql.COLLOCATIONS})").fetchall()
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(QUERIES["op11_phrase_collocations"](spark, SMALL)) == sorted(want) == by_hand(rows, 30)
