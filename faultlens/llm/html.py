"""HTML extraction: templates of hosts from equivalence classes of tokens, text from the slots."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import join_groups, keyed, map_texts, stored
from faultlens.plans.bounded import is_small, small

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements of HTML by how they are read.
RAW = frozenset("script style template noscript textarea svg iframe object select math canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
MAIN = frozenset(("article", "main"))
# Parts that are never the article, by element, or by a class or role of these words.
NOT_TEXT = frozenset("head title nav aside footer form button dialog menu menuitem fieldset input".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comments comment disqus replies reply respond "
    "toolbar toc pagination pager widget skip search form contentinfo complementary".split()
)
# Words that may stand beside those in a class, as in "comment-list" or "main-nav".
PLAIN_WORDS = frozenset(
    "site page main top bottom left right global primary secondary list item items box bar block section container wrapper wrap inner "
    "area slot unit link links button buttons text content group panel header footer posts post reader user js new".split()
)
# A token belongs to a host's template if it is at its place on this share of its pages, of at least so many.
SHARE, LEAST_PAGES = 0.9, 5
# What of all hosts may be broadcast, rows a task holds before it hands them on, and templates it keeps read.
MOST_HOSTS, MOST_HOST_BYTES, HELD_ROWS, HELD_TEMPLATES = 100_000, 16 << 20, 20_000, 1000


@dataclass
class Part:
    """An open element: what it adds to the path, and whether it is main text or surely not."""

    tag: str
    path: str
    main: bool
    out: bool


@dataclass
class Page:
    """Blocks (path, in main part, excluded, text) in page order; all tokens in page order, and which of them the blocks are.

    Tokens are the paths of elements where they begin, again with a `>` where they end, and texts under their path.
    """

    blocks: list[tuple[str, bool, bool, str]] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)


def excluded(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is a menu, header, notice, form and so on by its own marks."""
    if tag in NOT_TEXT or tag in RAW:
        return True
    if tag == "header" and not in_main:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(marked(token) or token == "header" and not in_main for m in ATTRIBUTE.finditer(attributes) for token in (m[2] or m[3] or m[4] or "").lower().split())


def marked(token: str) -> bool:
    """Whether a whole class says that its element is not the article.

    "ad" and "comment-list" do; "share-price-review" and "has-sidebar" do not, as they say something else besides.
    """
    words = {w for w in re.split(r"[-_]+", token) if w}
    return bool(words & NOT_TEXT_WORDS) and words <= NOT_TEXT_WORDS | PLAIN_WORDS


def mark(tag: str, attributes: str) -> str:
    m = re.search(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", attributes, re.I) if attributes else None
    return f"{tag}.{'.'.join((m[1] or m[2] or m[3] or '').split())}" if m else tag


def read(html: str) -> Page:
    """Splits a page into blocks. Unclosed and wrongly nested elements do not hide later text."""
    page, stack, text = Page(), [Part("", "", False, False)], []
    pos, end = 0, len(html)

    def flush() -> None:
        block = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if block:
            top = stack[-1]
            page.blocks.append((top.path, top.main, top.out, block))
            page.at.append(len(page.tokens))
            page.tokens.append(f"{top.path}\n{block}")

    def close(k: int) -> None:
        page.tokens.extend(f"{part.path}>" for part in reversed(stack[k:]))
        del stack[k:]

    while pos < end:
        m = TOKEN.search(html, pos)
        if m is None:
            text.append(html[pos:])
            break
        text.append(html[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW and not closing:
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
            page.tokens.append(f"{stack[-1].path}/{tag}")
            pos = shut.end() if shut else end
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in CLOSES_ITSELF or stack[-1].tag == "p":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or stack[k].tag == "p" and tag not in INLINE:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "div", "section", "article", "body", "td"):
                    break
        top = stack[-1]
        path = f"{top.path}/{mark(tag, attributes)}"
        page.tokens.append(path)
        if tag not in VOID:
            main = top.main or tag in MAIN or "role=\"main\"" in attributes
            stack.append(Part(tag, path, main, top.out or excluded(tag, attributes, top.main)))
    flush()
    close(1)
    return page


def digests(page: Page) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in page.tokens]


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def increasing(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of (place, position), given by position, whose places increase."""
    if all(a[0] < b[0] for a, b in zip(found, found[1:])):
        return found
    ends, last, before = [], [], []
    for i, (place, _) in enumerate(found):
        k = bisect_left(ends, place)
        before.append(last[k - 1] if k else -1)
        ends[k:k + 1], last[k:k + 1] = [place], [i]
    out, i = [], last[-1]
    while i >= 0:
        out.append(found[i])
        i = before[i]
    return out[::-1]


class Classes:
    """Equivalence classes of tokens in the order of their rank, each with its tokens in the order in which pages have them."""

    def __init__(self, classes: Sequence[Sequence[int]]):
        self.place = {token: (c, k) for c, members in enumerate(classes) for k, token in enumerate(members)}

    def lay(self, tokens: Sequence[int]) -> tuple[list[bool], list[int], dict[int, set[int]]]:
        """How the classes lie on a page: which tokens are at their place, the slot of each token, and each class's slots.

        As tokens of a class occur equally often, their j-th occurrences are its j-th instance. Of an
        instance the tokens in order are at their place. Instances lie apart or within one slot of another;
        of two that cross, the one of lower rank is none. A slot is named by the token it follows in the
        innermost instance around it, and by 0 where there is none.
        """
        instances: dict[tuple[int, int], list[tuple[int, int]]] = {}
        seen: Counter = Counter()
        for i, token in enumerate(tokens):
            if token in self.place:
                c, k = self.place[token]
                instances.setdefault((c, seen[token]), []).append((k, i))
                seen[token] += 1
        owner, ends = {}, {}
        for own, found in instances.items():
            kept = increasing(found)
            ends[own] = kept[-1][1]
            owner |= dict.fromkeys((i for _, i in kept), own)
        stack, slot, around, broken = [], {}, {}, set()
        slots = []
        for i, token in enumerate(tokens):
            slots.append(slot[stack[-1]] if stack else 0)
            own = owner.get(i)
            if own is None or own in broken:
                continue
            if own not in slot:
                stack.append(own)
                around[own] = slots[i]
            elif stack[-1] != own:
                above = stack[stack.index(own) + 1 :]
                if any(a < own for a in above):
                    broken.add(own)
                    stack.remove(own)
                    continue
                broken.update(above)
                del stack[-len(above) :]
            slot[own] = token
            if i == ends[own]:
                stack.pop()
        kept = [i in owner and owner[i] not in broken for i in range(len(tokens))]
        of_class: dict[int, set[int]] = {}
        for own in instances:
            # A class with an instance that is none lies in no one slot.
            of_class.setdefault(own[0], set()).update((0, 1) if own in broken else (around[own],))
        return kept, slots, of_class


def refined(tokens: Sequence[int], classes: Classes) -> list[int]:
    """The tokens with those outside the classes told apart by the slot they are in."""
    _, slots, _ = classes.lay(tokens)
    parted = lambda token, slot: xxhash.xxh3_64_intdigest(token.to_bytes(8, "little", signed=True) + slot.to_bytes(8, "little", signed=True)) - (1 << 63)
    return [token if token in classes.place else parted(token, slot) for token, slot in zip(tokens, slots)]


class Rounds:
    """Reads rounds of classes from JSON, those of the hosts met last once each."""

    def __init__(self):
        self.read: dict[str, list[Classes]] = {}

    def __call__(self, text: str) -> list[Classes]:
        if text not in self.read:
            if len(self.read) >= HELD_TEMPLATES:
                self.read.clear()
            self.read[text] = [Classes(c) for c in json.loads(text)]
        return self.read[text]


def with_hosts(rows: DataFrame, hosts: DataFrame, few: bool) -> DataFrame:
    """`rows` with the one row of `hosts`, which has the pages of each, of their host; a host may have a third of all rows."""
    return rows.join(F.broadcast(hosts), "host") if few else join_groups(rows, hosts, ["host"], "pages")


def shapes(pages: DataFrame) -> tuple[DataFrame, bool]:
    """(host, pages, tokens, n): the frequent tokens of pages in page order, as many pages of a host as have them, and its pages in all.

    And whether what there is of all hosts is little enough to be broadcast.
    """

    def start() -> Callable:
        def order(texts: list[str]) -> tuple[None, dict]:
            return None, {"tokens": [np.array(digests(read(text)), "<i8").tobytes() for text in texts]}

        return order

    read_once = stored(map_texts(pages, F.col("host"), F.col("html"), "tokens binary", start).withColumnRenamed("payload", "host"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [np.unique(np.frombuffer(t, "<i8")) for t in part.column(1).to_pylist()]
                index = np.repeat(np.arange(len(own)), [len(t) for t in own])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), pa.array(np.concatenate([np.empty(0, "<i8"), *own]), pa.int64())], names=["host", "token"])

    on = read_once.mapInArrow(each, "host string, token long").groupBy("host", "token").agg(F.count(F.lit(1)).alias("on"))
    sizes = read_once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    frequent = on.join(sizes, "host").where(F.col("on") >= SHARE * F.col("pages"))
    hosts = stored(frequent.groupBy("host", "pages").agg(F.array_sort(F.collect_list("token")).alias("frequent")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                all_, some = [np.frombuffer(t, "<i8") for t in part.column(2).to_pylist()], part.column(3)
                left = [t[np.isin(t, some[i].values.to_numpy())].tobytes() for i, t in enumerate(all_)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(left, pa.binary())], names=["host", "pages", "tokens"])

    few = is_small(hosts, MOST_HOSTS, MOST_HOST_BYTES)
    own = with_hosts(read_once, hosts, few).select("host", "pages", "tokens", "frequent").mapInArrow(cut, "host string, pages long, tokens binary")
    return stored(own.groupBy("host", "pages", "tokens").agg(F.count(F.lit(1)).alias("n"))), few


def candidates(rows: DataFrame) -> DataFrame:
    """(host, pages, rounds, found, most): the classes of each host's tokens as `rounds` tell them apart, as JSON, and their number.

    A token's occurrence vector is taken as the exclusive or of hashes of (shape of page, count). The order
    of a class is that of the mean places of its tokens; classes rank by pages, then by tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, kinds = Rounds(), [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        held: list[tuple] = []

        def hand_on() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in zip(kinds, columns)], names=["host", "pages", "rounds", "shape", "n", "token", "times", "place"])
            held.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["tokens"], "<i8").tolist()
                shape = xxhash.xxh3_64_intdigest(row["tokens"]) - (1 << 63)
                for classes in rounds(row["rounds"]):
                    tokens = refined(tokens, classes)
                times, first = Counter(tokens), {token: len(tokens) - 1 - i for i, token in enumerate(reversed(tokens))}
                held += [(row["host"], row["pages"], row["rounds"], shape, row["n"], token, times[token], i * row["n"]) for token, i in first.items()]
                if len(held) > HELD_ROWS:
                    yield hand_on()
        yield hand_on()

    host = ["host", "pages", "rounds"]
    met = rows.mapInArrow(run, "host string, pages long, rounds string, shape long, n long, token long, times long, place long")
    vector = F.bit_xor(F.xxhash64("shape", "times")).alias("vector")
    tokens = met.groupBy(*host, "token").agg(F.sum("n").alias("on"), vector, F.sum("place").alias("place"))
    frequent = tokens.where(F.col("on") >= SHARE * F.col("pages"))
    members = F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members")
    classes = frequent.groupBy(*host, "on", "vector").agg(members)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("on")).alias("on"), (-F.size("members")).alias("size"), "members")))
    found = F.to_json(F.transform(ranked, lambda c: c["members"]["token"])).alias("found")
    return classes.groupBy(*host).agg(found, F.sum(F.size("members")).alias("most"))


def valid(rows: DataFrame) -> DataFrame:
    """(host, classes, new): of the candidates what is valid, as JSON, and its tokens.

    A token is valid where it is in the order of its class and all instances of the class lie in one slot, and
    that with the same slot on SHARE of the host's pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, held = Rounds(), Counter()

        def hand_on() -> pa.RecordBatch:
            kinds = {"host": pa.string(), "pages": pa.int64(), "class": pa.int64(), "place": pa.int64(), "token": pa.int64(), "slot": pa.int64()}
            columns = list(zip(*held)) or [()] * len(kinds)
            batch = pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), columns)} | {"n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["tokens"], "<i8").tolist()
                for classes in rounds(row["rounds"]):
                    tokens = refined(tokens, classes)
                (found,) = rounds(f"[{row['found']}]")
                kept, _, slots = found.lay(tokens)
                wrong = {token for token, at_place in zip(tokens, kept) if not at_place}
                for token in {*tokens} - wrong:
                    c, k = found.place[token]
                    if len(slots[c]) == 1:
                        held[row["host"], row["pages"], c, k, token, *slots[c]] += row["n"]
                if len(held) > HELD_ROWS:
                    yield hand_on()
        yield hand_on()

    met = rows.mapInArrow(run, "host string, pages long, class long, place long, token long, slot long, n long")
    at_place = met.groupBy("host", "pages", "class", "place", "token", "slot").agg(F.sum("n").alias("on")).where(F.col("on") >= SHARE * F.col("pages"))
    classes = at_place.groupBy("host", "class").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members"))
    ranked = F.array_sort(F.collect_list(F.struct("class", "members")))
    made = classes.groupBy("host").agg(ranked.alias("c"), F.sum(F.size("members")).alias("new"))
    return made.select("host", F.to_json(F.transform("c", lambda c: c["members"]["token"])).alias("classes"), "new")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, rounds): the template of each host as rounds of valid equivalence classes, as JSON.

    `pages` has host and html. Tokens of a host with the same occurrence vector are an equivalence
    class; it is valid as far as pages have its tokens in one order, and it in one slot of the class around it. Tokens
    outside valid classes are then told apart by their slots, which gives further classes, until a round adds none to a host's
    template. Pages that are alike in their frequent tokens are looked at once; what each gives is added
    up before the shuffle, so a host may hold a third of all pages.
    """
    met, few = shapes(pages)
    sizes = met.groupBy("host").agg(F.first("pages").alias("pages"))
    known = stored(sizes.withColumns({"rounds": F.lit("[]"), "size": F.lit(0).cast("long"), "open": F.lit(True)}))
    rows = met.drop("pages")
    while not known.where("open").isEmpty():
        found = stored(candidates(with_hosts(rows, known.where("open").select("host", "pages", "rounds"), few)))
        new = found.select("host", "most").join(valid(with_hosts(rows, found.drop("most"), few)), "host")
        grown = F.coalesce(F.col("new") > F.col("size"), F.lit(False))
        more = F.concat(F.expr("substr(rounds, 1, length(rounds) - 1)"), F.when(F.col("rounds") != "[]", ",").otherwise(""), F.col("classes"), F.lit("]"))
        joined = known.join(new, "host", "left")
        # Nothing is left to tell apart where all tokens that are frequent enough are valid.
        known = stored(joined.select(
            "host", "pages", F.when(grown, more).otherwise(F.col("rounds")).alias("rounds"),
            F.when(grown, F.col("new")).otherwise(F.col("size")).alias("size"), (grown & (F.col("new") < F.col("most"))).alias("open"),
        ))
    return known.select("host", "pages", "rounds")


def in_template(page: Page, rounds: Sequence[Classes]) -> frozenset[int]:
    """The numbers of the blocks that are at their place in the template."""
    tokens = digests(page)
    for classes in rounds[:-1]:
        tokens = refined(tokens, classes)
    kept = rounds[-1].lay(tokens)[0] if rounds else [False] * len(tokens)
    return frozenset(b for b, i in enumerate(page.at) if kept[i])


def slots(page: Page, fixed: frozenset[int]) -> list[str]:
    """The texts in the slots of the template that hold the article; `fixed` numbers the blocks of the template.

    Texts of the template go wherever they stand, inside an article or main part too. The rest of
    such a part is the article, unless it is the lesser half of what is left on the page, as a teaser is; then
    all that is not marked as something else is taken. Where the template would take
    most of an article's text, or all of a page's, the host's pages are copies of one another, and it is left alone.
    """
    size = lambda blocks: sum(len(text) for *_, text in blocks)
    open_ = [b for b in page.blocks if not b[2]]
    left = [b for i, b in enumerate(page.blocks) if not b[2] and i not in fixed]
    inside, whole = [b for b in left if b[1]], [b for b in open_ if b[1]]
    if 2 * size(inside) < size(whole):
        left = inside = whole
    if inside and 2 * size(inside) >= size(left):
        left = inside
    return [text for *_, text in left or open_]


def extract(pages: DataFrame, payload: Column, url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: payload and the main text, its blocks joined by one line feed.

    NULL html counts as empty and gives an empty text; a NULL url is a host of its
    own. Repeated rows agree. An empty table gives an empty result.
    """
    rows, _ = keyed(pages)  # read again and again: each time the same rows
    rows = rows.select(payload.alias("own"), host(F.col(url)).alias("host"), F.col(html).alias("html"))
    known = templates(rows.select("host", "html")).select("host", "rounds")
    joined = rows.join(small(known, MOST_HOSTS, MOST_HOST_BYTES), "host", "left")

    def start() -> Callable:
        rounds = Rounds()

        def cut(texts: list[str]) -> tuple[None, dict]:
            out = []
            for text in texts:
                template, text = text.split("\n", 1)
                page = read(text)
                out.append("\n".join(slots(page, in_template(page, rounds(template)))))
            return None, {"text": out}

        return cut

    with_rounds = F.concat_ws("\n", F.coalesce("rounds", F.lit("[]")), F.coalesce("html", F.lit("")))
    return map_texts(joined, F.col("own"), with_rounds, "text string", start)
