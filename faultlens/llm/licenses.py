"""License scans: TF-IDF cosine of lines and files to templates, inherited down the directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import keyed, let, stored

# Short notices by which licenses are declared, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)
# A line is compared only if one of these, which every template has, is in it.
SIGNS = "licen[sc]e|permission|redistribution|public domain"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST_COSINE = 0.75
# Words that a file may have besides a short notice and still be a licence file of its directory.
MOST_OTHER_WORDS = 30
# A licence file by its name, whatever else it says besides a notice.
LICENCE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying)(?:[._-][^/]*)?$"
# Lines that a notice may be wrapped over.
MOST_LINES = 3
# Full license texts, one per file, named by their identifiers. A file is one of them by this cosine.
FULL_TEXTS = Path(__file__).parent / "license_texts"
LEAST_FILE_COSINE = 0.85
LEAST_FILE_TERMS = 60
# License texts that are told from another one by a word among the first of a file.
TITLES = (("GPL-3.0", "affero", "AGPL-3.0"),)
TITLE_TERMS = 12


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def signs(text: Column) -> Column:
    """Whether a text has a sign, be it wrapped over two lines."""
    return F.translate(F.lower(text), "\n", " ").rlike(SIGNS)


def vocabulary() -> list[str]:
    return sorted({t for _, notice in TEMPLATES for t in re.findall(TERM, notice.lower())})


def rarity(files: DataFrame, text: str) -> tuple[dict[str, float], float]:
    """idf of the templates' terms over all files, and that of a term that no file has.

    idf = ln((1 + files) / (1 + files with the term)) + 1. Only one number per term of
    the templates comes to the driver.
    """
    listed = F.array(*[F.lit(t) for t in vocabulary()])
    present = F.array_intersect(terms(F.coalesce(F.col(text), F.lit(""))), listed)
    counted = files.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}
    total = df.get("", 0)
    return {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in vocabulary()}, math.log(1 + total) + 1


def template_vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """TF-IDF vectors of unit length, one per template."""
    out = []
    for _, notice in TEMPLATES:
        tf = Counter(re.findall(TERM, notice.lower()))
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in tf.items()))
        out.append({t: k * idf[t] / norm for t, k in tf.items()})
    return out


def best_template(found: Column, idf: dict[str, float], rare: float) -> Column:
    """struct<less, license>: minus the best cosine of an array of terms to a template, and its license.

    The terms are sorted and folded by runs, so each distinct one adds its weight once.
    Terms that no template has weigh as much as one that no file has, so the more a
    line says besides, the less it matches. Ties go to the license first by name.
    """
    vectors = template_vectors(idf)
    entries = [(t, F.struct(F.lit(w).alias("idf"), F.array(*[F.lit(v.get(t, 0.0)) for v in vectors]).alias("w"))) for t, w in idf.items()]
    known = F.create_map(*[x for t, e in entries for x in (F.lit(t), e)])
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])

    def closed(s: Column) -> Column:
        def add(entry: Column) -> Column:
            v = s["run"] * F.coalesce(entry["idf"], F.lit(rare))
            dots = F.when(entry.isNull(), s["dots"]).otherwise(F.zip_with(s["dots"], entry["w"], lambda a, b: a + v * b))
            return F.struct((s["square"] + v * v).alias("square"), dots.alias("dots"))

        return let(F.try_element_at(known, s["term"]), add)

    def step(s: Column, x: Column) -> Column:
        def opened(c: Column) -> Column:
            return F.struct(x.alias("term"), F.lit(1).alias("run"), c["square"].alias("square"), c["dots"].alias("dots"))

        same = F.struct(s["term"].alias("term"), (s["run"] + 1).alias("run"), s["square"].alias("square"), s["dots"].alias("dots"))
        return F.when(s["term"] == x, same).otherwise(let(closed(s), opened))

    def finish(s: Column) -> Column:
        def score(c: Column) -> Column:
            cosines = F.transform(c["dots"], lambda d, i: F.struct((-F.round(d / F.sqrt(c["square"]), 6)).alias("less"), F.get(names, i).alias("license")))
            return F.array_min(cosines)

        return let(closed(s), score)

    start = F.struct(F.lit("").alias("term"), F.lit(0).alias("run"), F.lit(0.0).alias("square"), F.array(*[F.lit(0.0) for _ in vectors]).alias("dots"))
    return F.aggregate(F.sort_array(found), start, step, finish)


def notice(text: Column, idf: dict[str, float], rare: float, least: float) -> Column:
    """struct<less, line, license, line_words> of the best line or window of lines of a text, the first of equals; NULL below `least`."""

    def windows(lines: Column) -> Column:
        def at(i: Column, k: int) -> Column:
            return F.struct(i.alias("line"), F.array_join(F.slice(lines, i + 1, F.lit(k)), " ").alias("said"))

        starts = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.concat(*[F.filter(F.transform(starts, lambda i: at(i, k)), lambda x: F.lower(x["said"]).rlike(SIGNS)) for k in range(1, MOST_LINES + 1)])

    signed = let(F.split(text, "\n"), windows)

    def judge(x: Column) -> Column:
        def named(found: Column) -> Column:
            best = best_template(found, idf, rare)
            return let(best, lambda b: F.struct(b["less"].alias("less"), x["line"].alias("line"), b["license"].alias("license"), F.size(found).alias("line_words")))

        return let(terms(x["said"]), named)

    found = F.array_min(F.filter(F.transform(signed, judge), lambda x: x["less"] <= -least))
    return F.when(signs(text), found)


def full_texts() -> dict[str, Counter]:
    """Terms of the full license texts by identifier; BSD-2-Clause is BSD-3-Clause without its third clause."""
    said = {f.name: f.read_text().lower() for f in sorted(FULL_TEXTS.iterdir())}
    said["BSD-2-Clause"] = re.sub(r"(?s)\n3\. neither the name.*?(?=\nthis software is provided)", "\n", said["BSD-3-Clause"])
    return {name: Counter(re.findall(TERM, text)) for name, text in sorted(said.items())}


def whole_files(bags: DataFrame) -> DataFrame:
    """(n, full_cosine, full_license): the full license text that a file is, by TF-IDF cosine of all its terms.

    `bags` has n and bag, an array of terms. Terms weigh 1 + ln of their number times
    their idf over the license texts; terms that none has weigh as the rarest.
    """
    texts = full_texts()
    names, total = list(texts), len(texts)
    df = Counter(t for tf in texts.values() for t in tf)
    idf = {t: math.log((1 + total) / (1 + k)) + 1 for t, k in df.items()}
    rare = math.log(1 + total) + 1
    weights = {name: {t: (1 + math.log(k)) * idf[t] for t, k in tf.items()} for name, tf in texts.items()}
    norms = {name: math.sqrt(sum(w * w for w in ws.values())) for name, ws in weights.items()}
    rows = [(t, idf[t], [weights[name].get(t, 0.0) / norms[name] for name in names]) for t in sorted(idf)]
    known = bags.sparkSession.createDataFrame(rows, "term string, idf double, w array<double>")
    counted = bags.select("n", F.explode("bag").alias("term")).groupBy("n", "term").agg(F.count(F.lit(1)).alias("k"))
    v = (1 + F.log("k")) * F.coalesce("idf", F.lit(rare))
    weighed = counted.join(F.broadcast(known), "term", "left").select("n", v.alias("v"), "w")
    dots = [F.sum(F.coalesce(F.col("v") * F.get("w", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(total)]
    summed = weighed.groupBy("n").agg(F.sum(F.col("v") * F.col("v")).alias("square"), *dots)
    cosines = F.array(*[F.struct((-F.round(F.col(f"d{i}") / F.sqrt("square"), 6)).alias("less"), F.lit(name).alias("license")) for i, name in enumerate(names)])
    best = summed.select("n", F.array_min(cosines).alias("b")).where(F.col("b.less") <= -LEAST_FILE_COSINE)
    return best.select("n", (-F.col("b.less")).alias("full_cosine"), F.col("b.license").alias("full_license"))


def scan(files: DataFrame, path: Column, payload: Column, text: str = "text", least: float = LEAST_COSINE, other_words: int = MOST_OTHER_WORDS) -> DataFrame:
    """One row per file: payload, path, own_license, cosine, license, from_dir.

    A file that is a full license text has that license; else its own notice counts.
    Other files have the license of the nearest directory above them that holds a
    licence file: one that is a full license text, or is named as one and has a notice,
    or has a notice and at most `other_words` more words. Of several the best cosine
    counts, then the first path, then the first license by name. from_dir is that directory, NULL for an own notice
    or none. NULL texts and paths have no license; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = files.select(payload.alias("payload"), path.alias("path"), t.alias("text"))
    rows = rows.withColumn("_dir", F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/[^/]*$", 1))
    idf, rare = rarity(rows, "text")
    best = notice(F.col("text"), idf, rare, least)
    whole = let(best, lambda b: F.when(b.isNotNull(), F.struct(b.alias("b"), F.size(terms(F.col("text"))).alias("n_terms"))))
    bag = let(terms(F.col("text")), lambda x: F.when(F.size(x) >= LEAST_FILE_TERMS, x))
    judged = rows.select("payload", "path", "_dir", whole.alias("x"), F.when(signs(F.col("text")), bag).alias("bag"))
    judged = judged.select("payload", "path", "_dir", "x.n_terms", "x.b.*", "bag").withColumn("n", F.monotonically_increasing_id())
    lines = stored(judged.select("n", "bag", "payload", "path", "_dir", "n_terms", "line_words", "license", (-F.col("less")).alias("cosine")))
    full = whole_files(lines.where("bag IS NOT NULL").select("n", "bag"))
    title = F.slice("bag", 1, TITLE_TERMS)
    full_license = F.col("full_license")
    for name, word, other in TITLES:
        full_license = F.when((F.col("full_license") == name) & F.array_contains(title, word), other).otherwise(full_license)
    said = stored(
        lines.join(full, "n", "left").select(
            "payload",
            "path",
            "_dir",
            F.coalesce(full_license, F.col("license")).alias("license"),
            F.coalesce("full_cosine", "cosine").alias("cosine"),
            (F.col("full_license").isNotNull() | F.col("path").rlike(LICENCE_NAME) | (F.col("n_terms") - F.col("line_words") <= other_words)).alias("_gives"),
        )
    )

    own = said.where("license IS NOT NULL AND path IS NOT NULL AND _gives")
    given = stored(own.groupBy("_dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("g")).select(F.col("_dir").alias("above"), F.col("g.license").alias("given")))
    parts = F.split("_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = said.where("license IS NULL AND path IS NOT NULL").select("_dir").distinct()
    nearest = (
        dirs.select("_dir", F.explode(ancestors).alias("a"))
        .select("_dir", "a.*")
        .join(given, "above")
        .groupBy("_dir")
        .agg(F.max(F.struct("depth", "above", "given")).alias("x"))
        .select(F.col("_dir"), F.col("x.above").alias("above"), F.col("x.given").alias("given"))
    )
    out = said.join(nearest, "_dir", "left")
    lacks = F.col("license").isNull() & F.col("path").isNotNull()
    return out.select(
        "payload",
        "path",
        F.col("license").alias("own_license"),
        "cosine",
        F.when(lacks, F.col("given")).otherwise(F.col("license")).alias("license"),
        F.when(lacks, F.col("above")).alias("from_dir"),
    )


def with_license(files: DataFrame, path: Column, text: str = "text", name: str = "license", **options) -> DataFrame:
    """The files with a column `name` that holds their license."""
    files, key = keyed(files)
    found = scan(files, path, F.col(key), text, **options).select(F.col("payload").alias(key), F.col("license").alias(name))
    return files.drop(name).join(found, key).drop(key)
