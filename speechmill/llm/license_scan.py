"""Licence scan: a trained paragraph classifier confirmed by templates, in DataFrame and spark.ml functions alone.

Each line of a text is a paragraph. A licence text wrapped over lines is looked for in windows from each line to the first of the next
ones, up to a line without words, with which a template is covered; it counts at the last line with which it can begin. Which of the word n-grams (one and two words) of the
phrases below a paragraph has is a sparse vector, and multinomial logistic regression gives each licence family and 'unknown' a probability. A family counts only if its probability reaches a
threshold calibrated on paragraphs kept out of the fit, and if the paragraph then holds most of the word pairs of one of that
family's templates. Otherwise the paragraph is unknown.

Learning: templates and their variants (bounded by the template list) against all paragraphs of the corpus. Paragraphs with one vector are one example that
counts as often as they occur; together they weigh UNKNOWN_WEIGHT examples at most, whatever the size of the corpus. The threshold is taken over all paragraphs kept out. Paragraphs like a template
are left out of the unknown side. Each line is cut into words once; its vector is stored for learning and scoring.

Defined results: null text has no paragraphs; blank lines aren't paragraphs; rows that repeat a doc_id are taken together; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UNKNOWN = "unknown"
#: Phrases by which licences are usually named in one line or at the start of their text.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license, version 2.0", "apache license version 2.0, january 2004", "spdx-license-identifier: apache-2.0"),
    "mit": ("released under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "spdx-license-identifier: mit", "licensed under the mit license"),
    "gpl-3.0": ("licensed under the gnu general public license, version 3", "gnu general public license version 3, 29 june 2007", "spdx-license-identifier: gpl-3.0-only", "under the terms of the gnu general public license as published by the free software foundation, either version 3"),
    "gpl-2.0": ("licensed under the gnu general public license, version 2", "gnu general public license version 2, june 1991", "spdx-license-identifier: gpl-2.0-only"),
    "lgpl": ("licensed under the gnu lesser general public license", "spdx-license-identifier: lgpl-2.1-only", "gnu lesser general public license version 3"),
    "bsd": ("licensed under the bsd 3-clause license", "redistribution and use in source and binary forms, with or without modification, are permitted", "spdx-license-identifier: bsd-3-clause", "released under the bsd license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license, v. 2.0", "mozilla public license version 2.0", "spdx-license-identifier: mpl-2.0"),
    "cc-by": ("licensed under cc by 4.0", "creative commons attribution 4.0 international license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"),
    "cc0": ("cc0 1.0 universal public domain dedication", "released under cc0 1.0", "spdx-license-identifier: cc0-1.0"),
    "proprietary": ("all rights reserved", "proprietary and confidential. unauthorized copying is strictly prohibited"),
}
FRAMES = ("{}", "{}.", "this work is {}.", "this file is {}", "copyright (c) 2020 the authors. {}.", "# {}", "see the file for details: {}", "{} or later", "the text below is {} unless noted")
#: Lines that speak of licences and name none.
OTHER = (
    "he lost his driving license", "the license fee was paid in full", "a general license to do as one likes", "the version of the file is 2.0", "the public library is open", "terms of the contract apply", "a copy of the book",
    "under the terms of the agreement", "free of charge for members", "permission was granted by the owner", "the foundation published a report", "use in source of water", "the rights of others are reserved for later", "licensed to drive",
    "by the common of the village", "the gnu is an animal", "mit students released a film", "apache helicopters flew over the town", "international conference, version one",
)
#: Examples that all paragraphs of the corpus weigh together, at most.
UNKNOWN_WEIGHT = 2000.0
COVER = 0.75
LEAST, MOST = 0.5, 0.95


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and the signs inside names and versions."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[.+-]?[a-z0-9\p{L}\p{N}]++(?:[.+-][a-z0-9\p{L}\p{N}]++)*+"), F.lit(0))


def grams(text_words: Column) -> Column:
    """Words, and pairs of neighbours."""
    n = F.size(text_words)
    pairs = F.when(n > 1, F.zip_with(F.slice(text_words, 1, n - 1), F.slice(text_words, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(text_words, pairs)


def _clean(phrase: str) -> list[str]:
    return re.sub(r"[^\w.+-]+|[.+-]+(?!\w)", " ", phrase.lower()).split()


def template_pairs(phrase: str) -> list[str]:
    """The word pairs of a template, by the same rule as words()."""
    clean = _clean(phrase)
    return [f"{a} {b}" for a, b in zip(clean, clean[1:])] or clean


def cover(own: Column, family: str) -> Column:
    """The largest share of a template's pairs that the paragraph has."""
    shares = [F.size(F.array_intersect(own, F.array(*map(F.lit, sorted(set(template_pairs(p))))))) / F.lit(float(len(set(template_pairs(p))))) for p in TEMPLATES[family]]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def phrases() -> list[tuple[str, str]]:
    """family, line: what a licence's line looks like, and lines that only speak of licences."""
    rows = [(family, frame.format(p)) for family, own in TEMPLATES.items() for p in own for frame in FRAMES]
    return rows + [(UNKNOWN, frame.format(p)) for p in OTHER for frame in FRAMES[:3]]


def vocabulary() -> list[str]:
    """The n-grams of all phrases, by the same rule as grams()."""
    found = set()
    for _, line in phrases():
        clean = _clean(line)
        found.update(clean, (f"{a} {b}" for a, b in zip(clean, clean[1:])))
    return sorted(found)


def known_grams(rows: DataFrame, column: str) -> DataFrame:
    """rows with own (the distinct n-grams of an array of words that are in the vocabulary, sorted) in place of the array. Pairs are made of known words only."""
    every = vocabulary()
    single = [x for x in every if " " not in x]
    rows = rows.withColumn("known", F.transform(column, lambda w: F.when(w.isin(single), w).otherwise("")))
    n = F.size("known")
    pair = lambda a, b: F.when((a == "") | (b == ""), "").otherwise(F.concat(a, F.lit(" "), b))
    pairs = F.when(n > 1, F.zip_with(F.slice("known", 1, n - 1), F.slice("known", 2, n - 1), pair)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("own", F.array_sort(F.array_distinct(F.filter(F.concat("known", pairs), lambda x: x.isin(every))))).drop("known", column)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its line number from 0), n_grams, fold (of 5, after the line), own (its n-grams of the vocabulary)."""
    lines = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.posexplode_outer(F.split("text", "\n")).alias("paragraph", "line"))
    cut = lines.select("doc_id", "paragraph", F.pmod(F.xxhash64("line"), F.lit(5)).cast("int").alias("fold"), words(F.coalesce("line", F.lit(""))).alias("words"))
    return known_grams(cut.withColumn("n_grams", F.greatest(F.lit(0), 2 * F.size("words") - 1)), "words")


def key_words() -> list[str]:
    """Words of which a text has at least one if it covers some template."""
    found = set()
    for p in (p for phrases in TEMPLATES.values() for p in phrases):
        pairs = [x.split() for x in set(template_pairs(p))]
        rest, names = pairs, sorted({w for x in pairs for w in x}, key=lambda w: (-len(w), w))
        while len(rest) >= COVER * len(pairs):
            rest = [x for x in rest if names[0] not in x]
            found.add(names.pop(0))
    return sorted(found)


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (the line that begins it), own, line, rest: n-grams of windows of two lines or more that cover a template, of their first line, and of the others."""
    pairs = sorted({x for phrases in TEMPLATES.values() for p in phrases for x in template_pairs(p)})
    # a template that begins in a line ends within so many words after it
    reach = max(len(template_pairs(p)) for phrases in TEMPLATES.values() for p in phrases)
    keys = key_words()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.lower("text").alias("low")).where(reduce(Column.__or__, (F.col("low").contains(k) for k in keys)))
    rows = rows.select("doc_id", F.transform(F.split("text", "\n"), words).alias("lines"))
    # lines are followed by others only where one of them has a key word: without one no window covers a template
    rows = rows.withColumn("keyed", F.transform("lines", lambda w: F.exists(w, lambda x: x.isin(keys))))
    follow = lambda w, i: F.when((F.size(w) > 0) & F.array_contains(F.slice("keyed", i + 1, reach + 1), True), F.struct(w.alias("w"), F.slice("lines", i + 2, reach).alias("after")))
    rows = rows.select("doc_id", F.posexplode(F.transform("lines", follow)).alias("paragraph", "x")).where("x is not null")
    stop = F.array_position(F.transform("x.after", lambda w: F.size(w) == 0), True)
    rows = rows.select("doc_id", "paragraph", F.col("x.w").alias("w"), F.when(stop > 0, F.slice("x.after", 1, (stop - 1).cast("int"))).otherwise(F.col("x.after")).alias("after")).where("size(after) > 0")
    hits = F.array_intersect(grams(F.concat("w", F.slice(F.flatten("after"), 1, reach))), F.array(*map(F.lit, pairs)))
    rows = rows.withColumn("hits", hits).where("size(hits) > 0").where(F.greatest(*(cover(F.col("hits"), f) for f in TEMPLATES)) >= COVER).drop("hits")
    ends = F.transform("after", lambda _, k: F.slice("after", 1, k + 1))
    windows = F.transform(ends, lambda a: F.struct(grams(F.concat("w", F.flatten(a))).alias("own"), grams(F.flatten(a)).alias("rest")))
    rows = rows.select("doc_id", "paragraph", windows.alias("windows"), grams(F.col("w")).alias("line"))
    fits = lambda x: reduce(Column.__or__, (begins(x["own"], F.col("line"), x["rest"], f) for f in TEMPLATES))
    rows = rows.select("doc_id", "paragraph", "line", F.explode(F.slice(F.filter("windows", fits), 1, 1)).alias("x"))
    return rows.select("doc_id", "paragraph", "x.own", "line", "x.rest")


def begins(own: Column, line: Column, rest: Column, family: str) -> Column:
    """Whether a window covers a template of the family that neither its first line nor the others cover."""
    return (cover(own, family) >= COVER) & (cover(line, family) < COVER) & (cover(rest, family) < COVER)


def examples(lines: DataFrame, weight: float = UNKNOWN_WEIGHT) -> DataFrame:
    """family, own, held_out, weight. lines: as paragraphs() gives them."""
    spark = lines.sparkSession
    known = spark.createDataFrame(phrases(), "family string, line string").select("family", words(F.col("line")).alias("words"))
    known = known_grams(known, "words").withColumns({"held_out": F.pmod(F.xxhash64("family", F.concat_ws(" ", "own")), F.lit(5)) == 0, "weight": F.lit(1.0)})
    pairs = sorted({x for own in TEMPLATES.values() for p in own for x in template_pairs(p)})
    like = F.when(F.exists("own", lambda x: x.isin(pairs)), F.greatest(*(cover(F.col("own"), f) for f in TEMPLATES))).otherwise(0.0)
    groups = lines.where("n_grams > 0").groupBy("own", (F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("n")).where(like < 0.5)
    groups = stored(groups, "license-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, weight / total) if total else 1.0
    corpus = groups.select(F.lit(UNKNOWN).alias("family"), "own", "held_out", (F.col("n") * F.lit(share)).alias("weight"))
    return known.select("family", "own", "held_out", "weight").unionByName(corpus)


class Scanner:
    """The fitted pipeline, the families in the order of its classes, and the calibrated threshold."""

    def __init__(self, model: PipelineModel, families: list[str], threshold: float):
        self.model, self.families, self.threshold = model, families, threshold

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with family (the likeliest) and p (its probability)."""
        p = vector_to_array("probability")
        out = self.model.transform(rows).withColumn("p_all", p).drop("features", "rawPrediction", "probability")
        names = F.array(*map(F.lit, self.families))
        return out.select("*", F.array_max("p_all").alias("p"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("family")).drop("p_all", "prediction")


def train(docs: DataFrame, weight: float = UNKNOWN_WEIGHT, lines: DataFrame | None = None) -> Scanner:
    """Learn from all lines of docs. lines: paragraphs(docs), where they are stored already."""
    families = [UNKNOWN, *TEMPLATES]
    label = F.lit(0.0)
    for k, f in enumerate(families):
        label = F.when(F.col("family") == f, float(k)).otherwise(label)
    rows = stored(examples(lines if lines is not None else stored(paragraphs(docs), "license-lines"), weight).withColumn("label", label), "license-examples")
    counted = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="own", outputCol="features").setBinary(True)
    steps = [counted, LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-3, maxIter=60, tol=1e-5)]
    # each family stays in the fit even if all its rows were held out
    fitted = Pipeline(stages=steps).fit(rows.where("not held_out or family <> 'unknown'"))
    scanner = Scanner(fitted, families, LEAST)
    # no unknown paragraph that was kept out may reach the threshold
    worst = scanner.scored(rows.where(f"held_out and family = '{UNKNOWN}'").drop("family", "label")).where(F.col("family") != UNKNOWN).agg(F.max("p")).first()[0]
    scanner.threshold = min(MOST, max(LEAST, worst or 0.0))
    return scanner


def scan_paragraphs(docs: DataFrame, scanner: Scanner, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, paragraph, family, p, n_grams: families that reach the threshold and are confirmed, else 'unknown'; then a row of 0 n_grams for each window that is confirmed."""
    rows = scanner.scored(paragraphs(docs) if lines is None else lines)
    confirmed = F.lit(False)
    for f in TEMPLATES:
        confirmed = F.when(F.col("family") == f, cover(F.col("own"), f) >= COVER).otherwise(confirmed)
    sure = (F.col("p") > scanner.threshold) & (F.col("family") != UNKNOWN)
    rows = rows.select("doc_id", "paragraph", F.when(sure, F.when(confirmed, F.col("family")).otherwise(UNKNOWN)).otherwise(UNKNOWN).alias("family"), "p", "n_grams")
    again = scanner.scored(wrapped(docs))
    there = reduce(Column.__or__, ((F.col("family") == f) & begins(F.col("own"), F.col("line"), F.col("rest"), f) for f in TEMPLATES))
    return rows.unionByName(again.where(sure & there).select("doc_id", "paragraph", "family", "p", F.lit(0).alias("n_grams")))


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-separated, '' for none), first_paragraph (of a licence, else null)."""
    lines = stored(paragraphs(docs), "license-lines")
    rows = scan_paragraphs(docs, scanner or train(docs, lines=lines), lines)
    found = F.col("family") != UNKNOWN
    # the sets hold at most one entry for each family of TEMPLATES
    return rows.groupBy("doc_id").agg(
        F.sum(F.when(F.col("n_grams") > 0, 1).otherwise(0)).cast("long").alias("n_paragraphs"),
        F.sum(found.cast("long")).alias("n_licensed"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("family")))), ",").alias("families"),
        F.min(F.when(found, F.col("paragraph"))).alias("first_paragraph"),
    )
