"""Secret scans: fixed patterns, and strings that a token vocabulary cannot compress."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import map_texts

# The base patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "random")

# A random base64 string has about 1.5 characters per token, prose 3 to 5.
MOST_RATIO = 2.1
# For letters of one case: random ones have about 1.65, and 1 % of long invented words up to 2.0.
MOST_RATIO_ONE_CASE = 1.95
LEAST_CHARS = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NAME_PARTS = re.compile(r"[_/=+-]+")
PATH_PART = re.compile(r"[^/=]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_known(s: str) -> bool:
    """Whether a string is a digest, a UUID or made of plain numbers, so that it may look random and tell nothing.

    Digests are hexadecimal of a usual digest length.
    """
    if UUID.fullmatch(s):
        return True
    if len(s) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return True
    return all(not part or part.isdigit() for part in NAME_PARTS.split(s))


def name_words(s: str) -> list[str] | None:
    """The words of a name, whose parts are numbers and words of one case; None for other strings."""
    parts = [p for p in NAME_PARTS.split(s) if p and not p.isdigit()]
    return parts if all(p.isalpha() and (p.islower() or p.isupper() or p.istitle()) for p in parts) else None


class Efficiency:
    """Characters per token under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, s: str) -> float:
        return len(s) / len(self.encoding.encode_ordinary(s))


def is_random(s: str, ratio: Efficiency, most: float) -> bool:
    """Whether a string is long enough, not known and needs more than one token per `most` characters.

    Names are held to the stricter limit, without their numbers.
    """
    if len(s) < LEAST_CHARS or is_known(s):
        return False
    words = name_words(s)
    if words is None:
        return ratio(s) <= most
    return sum(map(len, words)) >= LEAST_CHARS and ratio("-".join(words)) <= min(most, MOST_RATIO_ONE_CASE)


def random_parts(s: str, ratio: Efficiency, most: float) -> list[tuple[int, int]]:
    """The random stretches of a run: all of it, or neighbouring parts between / and = that are dense in tokens."""
    parts = [(m.start(), m.end()) for m in PATH_PART.finditer(s)]
    if is_random(s, ratio, most):
        # Names of a path around it are not part of the secret.
        plain = [name_words(s[a:b]) is not None and ratio(s[a:b]) > most for a, b in parts]
        if any(plain) and not all(plain):
            first, last = plain.index(False), len(plain) - 1 - plain[::-1].index(False)
            a, b = parts[first][0] if first else 0, parts[last][1] if last < len(parts) - 1 else len(s)
            if is_random(s[a:b], ratio, most):
                return [(a, b)]
        return [(0, len(s))]
    if len(parts) < 2:
        # A part alone, perhaps with slashes around it, has been looked at as a whole.
        return [(a, b) for a, b in parts if b - a < len(s) and is_random(s[a:b], ratio, most)]
    groups, last = [], False
    for a, b in parts:
        dense = ratio(s[a:b]) <= most
        if dense and last:
            groups[-1] = (groups[-1][0], b)
        elif dense:
            groups.append((a, b))
        last = dense
    out = []
    for a, b in groups:
        if is_random(s[a:b], ratio, most):
            out.append((a, b))
        else:
            # Numbers or names beside a random part may hide it.
            out += [(x, y) for x, y in parts if a <= x and y <= b and is_random(s[x:y], ratio, most)]
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], ratio: Efficiency, most: float) -> list[tuple[int, int, int]]:
    """Random stretches of the candidates, and of what `taken` leaves of them."""
    out = []
    for m in CANDIDATE.finditer(text):
        free, at = [], m.start()
        for a, _, b in taken:
            if a < m.end() and at < b:
                free.append((at, a))
                at = b
        for start, end in [*free, (at, m.end())]:
            if end - start >= LEAST_CHARS:
                out += [(start + a, 3, start + b) for a, b in random_parts(text[start:end], ratio, most)]
    return out


def scan(docs: DataFrame, payload: Column, vocabulary: str, pattern: str, text: str = "text", most_ratio: float = MOST_RATIO) -> DataFrame:
    """One row per document: payload and arrays `base` and `added` of (kind, start, end).

    Offsets are code points, ends exclusive. NULL counts as empty and has no spans.
    Each row is looked at on its own, so repeated rows agree.
    """
    span = "array<struct<kind:string,start:int,end:int>>"

    def start() -> Callable:
        ratio = Efficiency(vocabulary, pattern)

        def named(spans: list[tuple[int, int, int]]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

        def look(texts: list[str]) -> tuple[None, dict]:
            base = [base_spans(t) for t in texts]
            added = [random_spans(t, b, ratio, most_ratio) for t, b in zip(texts, base)]
            return None, {"base": [named(b) for b in base], "added": [named(a) for a in added]}

        return look

    return map_texts(docs, payload, F.col(text), f"base {span}, added {span}", start)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans by start, then by the order of `kinds`."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
