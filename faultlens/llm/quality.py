"""Quality rules: a threshold table compiled into one projection of text measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import let, without, words

SYMBOLS = "#*$%&|<>"
# The most frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for on with by this from be are as was or at an not "
    "le la les de des du un une et en que qui dans pour sur est au par avec pas ce se il "
    "der die das und den von zu mit sich dem für ist im nicht ein eine auf als auch es "
    "el los las y con por una del no su lo más al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if `measure` lies in [least, most]; a side of None is open."""

    measure: str
    least: float | None = None
    most: float | None = None


# The base limits of the contract are in `base_failed`; these are the method's own.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_length", least=2.5, most=12.0),
    Rule("symbol_ratio", most=0.2),
    Rule("stop_ratio", least=0.1),
    Rule("dup_line_ratio", most=0.4),
    Rule("repeat_ratio", most=0.5),
)


def repeated_words(w: Column, n: Column, bits: Column) -> Column:
    """Words of array `w` (of `n` < 2^bits) that lie in a 3-word window found twice or more.

    Windows are sorted as longs of hash and position. Equal neighbours are then
    compared word by word; if a hash ever stood for two windows, the text is
    counted again with the windows themselves as sort keys.
    """

    def covered(positions: Column) -> Column:
        def add(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(F.sort_array(positions), add)

    def repeats(sorted_: Column, same) -> Column:
        return F.filter(
            sorted_,
            lambda x, i: F.coalesce(same(x, F.get(sorted_, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_, i + 1)), F.lit(False)),
        )

    def gram(p: Column, k: int) -> Column:
        return F.get(w, (p + k).cast("int"))

    starts = F.slice(w, F.lit(1), F.greatest(n.cast("int") - 2, F.lit(0)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def top(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    packed = F.transform(
        starts,
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )

    def differs(a: Column, b: Column) -> Column:
        pairs = [gram(a.bitwiseAND(mask), k) != gram(b.bitwiseAND(mask), k) for k in range(3)]
        return F.coalesce((top(a) == top(b)) & (pairs[0] | pairs[1] | pairs[2]), F.lit(False))

    whole = F.sort_array(F.transform(starts, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.cast("long").alias("p"))))
    slow = let(whole, lambda s: covered(F.transform(repeats(s, lambda a, b: a["g"] == b["g"]), lambda x: x["p"])))

    def count(d: Column) -> Column:
        clash = F.exists(F.transform(d, lambda x, i: differs(x, F.get(d, i - 1))), lambda x: x)
        return F.when(clash, slow).otherwise(covered(F.transform(d, lambda x: x.bitwiseAND(mask))))

    fast = let(let(F.sort_array(packed), lambda s: repeats(s, lambda a, b: top(a) == top(b))), count)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(fast)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(own, m): each row of `docs` as a struct, and the struct of its measures; no user function, no shuffle.

    NULL and empty texts have no words and zero everywhere. A ratio over no words
    or lines is 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    plain = words(F.translate(F.lower(F.col(text)), ".,;:", ""))
    base = docs.select(F.struct("*").alias("own"), t.alias("t"), plain.alias("plain"), words(F.col(text)).alias("w"))
    base = base.withColumns({"n": F.size("w").cast("long"), "bits": F.length(F.bin(F.size("w"))).cast("int")})
    t, plain, w, n = F.col("t"), F.col("plain"), F.col("w"), F.col("n")
    lines = F.filter(F.split(t, "\n"), lambda x: without(x, " \t\x0b\x0c\r") != "")
    stop = F.size(F.filter(plain, lambda x: x.isin(STOP_WORDS)))
    counted = base.select(
        "own",
        F.struct(
            n.alias("n_words"),
            F.length(without(t, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.struct(F.size(a).cast("long").alias("all"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(w, n, F.col("bits")).alias("n_repeat_words"),
            stop.cast("long").alias("n_stop"),
        ).alias("c"),
    )
    c = F.col("c")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.greatest(b, F.lit(1)).cast("double"))

    return counted.select(
        "own",
        F.struct(
            c["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["lines"]["dup"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            ratio(c["word_chars"], c["n_words"]).alias("mean_word_length"),
            ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
            ratio(c["n_stop"], c["n_words"]).alias("stop_ratio"),
            ratio(c["lines"]["dup"], c["lines"]["all"]).alias("dup_line_ratio"),
            ratio(c["n_repeat_words"], c["n_words"]).alias("repeat_ratio"),
        ).alias("m"),
    )


def verdict(rules: Sequence[Rule] = RULES, measures: str = "m") -> Column:
    """The threshold table as one boolean column."""

    def holds(r: Rule) -> Column:
        m = F.col(f"{measures}.{r.measure}")
        parts = [F.lit(True)]
        if r.least is not None:
            parts.append(m >= r.least)
        if r.most is not None:
            parts.append(m <= r.most)
        return reduce(lambda a, b: a & b, parts)

    return reduce(lambda a, b: a & b, [holds(r) for r in rules], F.lit(True))


def base_failed(measures: str = "m") -> Column:
    n, rep = F.col(f"{measures}.n_words"), F.col(f"{measures}.n_repeat_words")
    return (n < 50) | (100 * rep > 50 * n)


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(own, m, base_failed, kept) for each row of `docs`, with the row itself in `own`.

    Every row gets a verdict on its own, so repeated rows and ties agree, an empty
    table stays empty, and columns of any other name pass through.
    """
    return measured(docs, text).withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with the columns they came with.

    The running number keeps the optimizer from putting the measures into the filter,
    where each rule would count them again.
    """
    judged = judge(docs, text, rules).withColumn("row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("row") >= 0)).select("own.*")
