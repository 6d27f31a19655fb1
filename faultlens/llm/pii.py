"""Personal data: fixed patterns, and terms that the corpus shows to disclose them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import fresh, keyed, let, stored
from faultlens.plans.bounded import small


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches are found as the plain one's are, but without backtracking.

    `hint` is a cheaper test that every text with a match passes.
    """

    name: str
    pattern: str
    hint: str


# The base patterns. A run of characters is entered at its start, or where the match
# before has ended (\G), and taken whole; that finds the same matches in linear time.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
NAMES = tuple(k.name for k in KINDS)
BYTE_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IP = rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$"
# A word, from its first letter or digit to its last.
TERM = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
# Characters on either side of protected data in which a term can tell of it.
REACH = 60
# A term discloses if its information on protected data reaches this share of what there is to
# know, -log2 P(protected). P(protected | term) is taken at the lower end of its Wilson interval of so many
# deviations, so a term seen once or twice proves nothing, and no count of documents is asked for.
DISCLOSURE, DEVIATIONS = 0.9, 1.0
CHUNK = 512


def placed(text: Column, pattern: str) -> Column:
    """array<struct<hit, start, end>> of the matches of `pattern`, in code points.

    Splitting by the pattern gives the gaps between the matches; lengths of both add
    up to positions, first within chunks, then over chunks, so that long arrays are
    not copied for each match.
    """
    point = "struct<hit:string,start:bigint,end:bigint>"

    def locate(pair: Column) -> Column:
        gaps, hits = pair["gaps"], pair["hits"]
        steps = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(h).cast("long").alias("len")))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))

        def over(chunks: Column) -> Column:
            zero = F.lit(0).cast("long")
            sums = F.transform(chunks, lambda ch: F.aggregate(ch, zero, lambda a, s: a + s["gap"] + s["len"]))
            begin = F.aggregate(sums, F.array(zero), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

            def within(ch: Column, start: Column) -> Column:
                empty = F.struct(start.alias("at"), F.array().cast(f"array<{point}>").alias("out"))

                def step(a: Column, s: Column) -> Column:
                    first = a["at"] + s["gap"]
                    spot = F.struct(s["hit"].alias("hit"), first.alias("start"), (first + s["len"]).alias("end"))
                    return F.struct((first + s["len"]).alias("at"), F.concat(a["out"], F.array(spot)).alias("out"))

                return F.aggregate(ch, empty, step)["out"]

            return let(begin, lambda b: F.flatten(F.transform(chunks, lambda ch, c: within(ch, F.get(b, c)))))

        return F.when(F.size(hits) == 0, F.array().cast(f"array<{point}>")).otherwise(let(parts, over))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(both, locate)


def luhn(number: Column) -> Column:
    """Whether the digits of a card number check: every second from the right counts double."""
    digits = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(IP)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, at, end, kind>> of all base matches, by start and then kind."""
    none = F.array().cast("array<struct<start:bigint,at:int,end:bigint,kind:string>>")

    def of(i: int, k: Kind) -> Column:
        good = F.filter(placed(text, k.pattern), lambda s: holds(k.name, s["hit"]))
        named = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("at"), s["end"].alias("end"), F.lit(k.name).alias("kind")))
        return F.when(text.rlike(k.hint), named).otherwise(none)

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def terms_at(text: Column) -> Column:
    """array<struct<term, start, end>> of the lower-cased words of a text."""
    return F.transform(placed(text, TERM), lambda w: F.struct(F.lower(w["hit"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))


def near_terms(text: Column, spans: Column) -> Column:
    """The lower-cased words within REACH of a span, the spans' own left out.

    A word that the far edge of the window cuts is left out; one that ends there is not.
    """

    def around(s: Column) -> Column:
        # One character more tells whether the edge cuts a word.
        begin = F.greatest(s["start"] - (REACH + 1), F.lit(0).cast("long"))
        before = F.substring(text, (begin + 1).cast("int"), (s["start"] - begin).cast("int"))
        before = F.when(F.length(before) > REACH, F.regexp_replace(before, r"^[^\x20\x09-\x0D]+", "")).otherwise(before)
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(REACH + 1))
        after = F.when(F.length(after) > REACH, F.regexp_replace(after, r"[^\x20\x09-\x0D]+\z", "")).otherwise(after)
        return F.concat(*[F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0)) for x in (before, after)])

    return F.array_distinct(F.flatten(F.transform(spans, around)))


def disclosing_terms(docs: DataFrame, rows: DataFrame, text: Column, disclosure: float) -> tuple[DataFrame, DataFrame]:
    """(key, term) of all words that are near protected data somewhere, wherever they stand, and the (term) that disclose it.

    `docs` has key; `rows` key, base and near. Terms near protected data are few; they meet the words of the
    corpus before these are counted, by a broadcast where they are measured to be small.
    """
    by_term = rows.select(F.explode("near").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("near_docs"))
    candidates = stored(by_term)
    every = docs.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term"))
    held = stored(every.join(small(candidates.select("term")), "term"))
    known = held.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).join(candidates, "term")
    totals = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.size("base") > 0).alias("protected")).first()
    share = totals["protected"] / totals["all"] if totals["all"] else 0.0
    # log2(given / share) >= disclosure * -log2(share), that is given >= share ** (1 - disclosure).
    n, p, z = F.col("docs"), F.col("near_docs") / F.col("docs"), DEVIATIONS
    given = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return held, stored(known.where(given >= F.lit((share or 1.0) ** (1 - disclosure))).select("term"))


def scan(docs: DataFrame, payload: Column, text: str = "text", disclosure: float = DISCLOSURE, key: str | None = None) -> DataFrame:
    """One row per document: payload, base and added spans as array<struct<start, at, end, kind>>.

    For each term near protected data the corpus gives P(protected near it | term) =
    documents with the term near them / documents with the term, at the lower end of its
    Wilson interval. Its information on protected data is log2 of that over P(protected). Terms that
    come to `disclosure` of -log2 P(protected) are added as kind `term` at each of their occurrences
    in the corpus, near protected data or not. Where all documents hold such data, no term can tell
    of it and none is added. `key` names a column that tells rows apart. NULL counts as empty; repeated rows count each. An empty table gives an empty result.
    """
    if key is None:
        docs, key = keyed(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), payload.alias("payload"), t.alias("t"))
    found = own.withColumn("base", base_spans(F.col("t")))
    terms = F.when(F.size("base") > 0, near_terms(F.col("t"), F.col("base")))
    rows = stored(found.select("key", "payload", "base", terms.alias("near")))

    held, disclosing = disclosing_terms(own, rows, F.col("t"), disclosure)
    holders = stored(held.join(small(disclosing), "term").groupBy("key").agg(F.collect_set("term").alias("terms")))
    none = F.array().cast("array<struct<start:bigint,at:int,end:bigint,kind:string>>")
    at = F.filter(terms_at(F.col("t")), lambda w: F.array_contains("terms", w["term"]))
    spans = F.transform(at, lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("at"), w["end"].alias("end"), F.lit("term").alias("kind")))
    added = own.select("key", "t").join(small(holders), "key").select("key", spans.alias("added"))
    joined = rows.select("key", "payload", "base").join(added, "key", "left").withColumn("added", F.coalesce("added", none))
    # Words that hold a base span or are part of one are covered by it.
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return joined.select("payload", "base", apart.alias("added"))


def sanitised(text: Column, spans: Column) -> Column:
    """`text` with each span put as its kind in capitals; spans must not overlap."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        fits = s["start"] >= a["at"]
        return F.when(fits, F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))).otherwise(a)

    def end(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))

    return F.aggregate(F.array_sort(spans), state, step, end)


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with protected data generalised to their kind, other columns as they were."""
    docs, key = keyed(docs)
    spans = fresh(docs, "_spans")
    found = scan(docs, F.col(key), text, key=key, **options).select(F.col("payload").alias(key), F.concat("base", "added").alias(spans))
    clear = F.when(F.size(spans) > 0, sanitised(F.col(text), F.col(spans))).otherwise(F.col(text))
    return docs.join(found, key).withColumn(text, clear).drop(key, spans)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
