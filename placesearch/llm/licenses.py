"""Licence notices by a trained paragraph classifier.

Word windows over runs of lines are compared with the notices.  A sparse logistic regression over word n-grams tells the
licence family, or that there is none.  It is trained on the notices below, on parts and variants of
them, and on all paragraphs of the corpus as the unknown class, of which those with equal terms are one
weighted row; its probabilities are calibrated on all of them, each judged by a model that was not
trained on it, so that of unknown ones no more than a stated share passes.  What
passes and repeats most of a notice, whatever stands around it, has the family of that notice.

Everything is DataFrame work; texts are not shuffled.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placesearch.llm.landing import drop, land, table, text_of

# Families and usual notices.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
               "file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "Licensed under the GNU General Public License, version 2 or later."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Released under the ISC License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                 "License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                 "International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright to the public domain "
            "under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
UNKNOWN = "unknown"
# Fixed value: words of licence texts; lines with one are not taken as unknown ones.
TERMS = ("license", "licensed", "licenses", "licensor", "licensee", "sublicense", "licence", "licensing", "copyright",
         "copyrighted", "copyleft", "spdx", "gnu", "warranty", "warranties", "merchantability", "noninfringement",
         "redistribute", "redistribution", "redistributions", "permission", "permissions", "unencumbered")
WEIGHT = 10_000.0         # of all unknown paragraphs together, at most
UNLIKE = 0.3              # similarity to a notice below which a paragraph may be an unknown one
STEPS = 10_000            # of the calibrated bound
PASSING = 0.001           # share of unknown paragraphs that may pass the classifier
SIMILAR = 0.6             # share of a notice's word pairs that a stretch must repeat
COPIES = 20               # weight of a notice against an unknown paragraph
_LONGEST = 200            # words of a paragraph that are compared at once; longer ones in parts


def words_of(column: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    """Pairs of neighbouring words, with marks before the first and behind the last."""
    row = F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))
    return F.zip_with(F.slice(row, 1, F.size(row) - 1), F.slice(row, 2, F.size(row) - 1),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text_of(), r"\r\n|\n|\r")).alias("paragraph", "line"))


def _in_words(lines: DataFrame) -> DataFrame:
    """``words`` instead of ``line``: only lines that have words; very long ones in several rows."""
    told = lines.withColumn("_words", words_of("line")).drop("line")
    # not a filter, which Spark would move to the lines, whose words it would look for twice
    parts = F.when(F.size("_words") > 0, F.transform(
        F.sequence(F.lit(1), F.size("_words"), F.lit(_LONGEST)), lambda at: F.slice("_words", at, _LONGEST)))
    return told.withColumn("words", F.explode(parts)).drop("_words")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, words`` of all lines that have words."""
    return _in_words(_lines(docs))


def _examples(spark: SparkSession) -> DataFrame:
    """The notices with their parts: halves, and each without one word."""
    rows = spark.createDataFrame(list(NOTICES), "family string, notice string").withColumn(
        "words", words_of("notice"))
    n = F.size("words")
    without = F.transform(F.sequence(F.lit(1), n), lambda at: F.concat(
        F.slice("words", F.lit(1), at - 1), F.slice("words", at + 1, n)))
    longer = F.when(n >= 12, F.array(F.slice("words", F.lit(1), F.ceil(n / 2).cast("int")),
                                     F.slice("words", F.ceil(n / 2).cast("int"), n))).otherwise(F.array())
    return rows.select("family", F.explode(F.concat(F.array("words"), without, longer)).alias("words"))


def _families() -> list[str]:
    return [UNKNOWN, *sorted({f for f, _ in NOTICES})]


def _label(column: str) -> Column:
    return F.array_position(F.lit(_families()), F.col(column)).cast("double") - 1


def _vocabulary() -> list[str]:
    """Words and pairs of the fixed notices: the terms that tell one family from another."""
    told = [re.findall(r"[^\W_]+", notice.lower()) for _, notice in NOTICES]
    return sorted({t for words in told for t in words}
                  | {f"{a} {b}" for words in told for a, b in zip(["^", *words], [*words, "$"])})


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _known(words: Column) -> Column:
    """The different single words and pairs of neighbouring ones that occur in a notice."""
    pairs = [t for t in _vocabulary() if " " in t]
    single = [t for t in _vocabulary() if " " not in t]
    row = F.transform(F.concat(F.array(F.lit("^")), words, F.array(F.lit("$"))),
                      lambda w: F.when(w.isin([*single, "^", "$"]), w))
    told = _once(row, lambda r: F.concat(
        F.filter(r, lambda w: w.isin(single)), F.filter(_inner(r), lambda p: p.isin(pairs))))
    return F.sort_array(F.array_distinct(told))


def _vectors(rows: DataFrame) -> DataFrame:
    """Adds ``features`` of ``terms``, or of the terms of ``words``."""
    rows = rows.withColumn("_terms", F.col("terms") if "terms" in rows.columns else _known(F.col("words")))
    return CountVectorizerModel.from_vocabulary(_vocabulary(), inputCol="_terms", outputCol="features").setBinary(
        True).transform(rows).drop("_terms")


def similarity(words: str, notices: DataFrame) -> Column:
    """Per notice the smaller of two shares of common word pairs: of the notice's and the paragraph's."""
    known = [(r.family, r.pairs) for r in notices.collect()]       # the fixed notices
    own = F.array_distinct(_pairs(F.col(words)))
    cells = []
    for family, pairs in known:
        common = F.size(F.array_intersect(own, F.lit(pairs)))
        cells.append(F.struct(F.least(common / len(pairs), common / F.size(own)).alias("similarity"),
                              F.lit(family).alias("confirmed")))
    return F.greatest(*cells)


def _unlike(lines: DataFrame) -> DataFrame:
    """The lines that are no licence text: unlike every notice, and without its usual words."""
    found = [r.pairs for r in _notices(lines.sparkSession).collect()]       # the fixed notices
    least = min(math.ceil(UNLIKE * len(p)) for p in found)

    def near(hits: Column) -> Column:
        own = F.size(F.array_distinct(_pairs(F.col("words"))))
        common = F.greatest(*[F.size(F.array_intersect(hits, F.lit(p))) / len(p) for p in found])
        # a line with fewer pairs of any notice is unlike all of them
        return F.when((F.size(hits) < least) | (common < UNLIKE) | (F.size(hits) / own < UNLIKE), 0.0).otherwise(
            similarity("words", _notices(lines.sparkSession))["similarity"])

    known = F.col("terms") if "terms" in lines.columns else _known(F.col("words"))
    hits = F.filter(known, lambda t: t.contains(" "))
    return lines.filter(F.when(F.exists("words", lambda w: w.isin(list(TERMS))), False).otherwise(
        _once(hits, near) < UNLIKE))


def unknown_terms(docs: DataFrame) -> DataFrame:
    """``terms, n0, n1`` of all paragraphs that are no licence text, those with equal terms summed.

    Each paragraph counts in one of two folds, by a hash of its words.
    """
    fold = F.pmod(F.xxhash64("words"), F.lit(2))
    # a row of its own, so that the filter stays behind it and the terms are looked for once
    lines = paragraphs(docs).select(F.explode(F.array(F.struct(
        "words", _known(F.col("words")).alias("terms")))).alias("_line")).select("_line.*")
    return (_unlike(lines).select("terms", fold.alias("_fold"))
            .groupBy("terms").agg(F.count_if(F.col("_fold") == 0).alias("n0"),
                                  F.count_if(F.col("_fold") == 1).alias("n1")))


def _fit(unknown: DataFrame, total: int) -> LogisticRegressionModel:
    """``unknown``: ``terms, n``, with ``total`` paragraphs in all; together they weigh ``WEIGHT`` at most."""
    known = _examples(unknown.sparkSession).select(
        _known(F.col("words")).alias("terms"), "family", F.lit(float(COPIES)).alias("weight"))
    others = unknown.filter("n > 0").select("terms", F.lit(UNKNOWN).alias("family"), (
        F.col("n") * min(1.0, WEIGHT / max(total, 1))).alias("weight"))
    return LogisticRegression(family="multinomial", maxIter=25, regParam=1e-4, elasticNetParam=0.0,
                              weightCol="weight", aggregationDepth=2).fit(
        _vectors(known.coalesce(1).unionByName(others)).withColumn("label", _label("family")))


def train(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the probability of a family from which it counts.

    All paragraphs are learned from as unknown ones but those that repeat a notice, or read like other
    licence text.  The bound is the lowest probability, in steps of ``1 / STEPS`` and at least a half,
    that no more than the share ``PASSING`` of them reaches, each judged by a model of the other fold.
    """
    unknown = land(unknown_terms(docs), "paragraphs")
    n0, n1 = (int(n or 0) for n in unknown.agg(F.sum("n0"), F.sum("n1")).first())
    fitted = _fit(unknown.select("terms", (F.col("n0") + F.col("n1")).alias("n")), n0 + n1)
    judged = [_best(unknown.filter(f"{other} > 0").select("terms", F.col(other).alias("n")),
                    _fit(unknown.select("terms", F.col(own).alias("n")), total))
              for own, other, total in (("n0", "n1", n0), ("n1", "n0", n1))]
    steps = (judged[0].unionByName(judged[1]).filter("probability >= 0.5")
             .groupBy(F.floor(F.col("probability") * STEPS).alias("step")).agg(F.sum("n").alias("n")))
    # at most STEPS / 2 + 1 rows
    left, bound = PASSING * (n0 + n1), 0.5
    for row in steps.orderBy(F.desc("step")).collect():
        left -= row.n
        if left < 0:
            bound = (row.step + 1) / STEPS
            break
    drop(unknown)
    return fitted, bound


def _notices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(NOTICES), "family string, notice string")
    return rows.select("family", F.array_distinct(_pairs(words_of("notice"))).alias("pairs"))


def _best(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Adds ``family`` and ``probability``: the likeliest family other than unknown."""
    told = model.transform(_vectors(rows)).withColumn("_p", vector_to_array("probability"))
    names = F.lit(_families())
    others = F.slice("_p", 2, len(_families()))
    top = F.array_max(others)
    return told.select(*rows.columns, F.element_at(names, (F.array_position(others, top) + 1).cast("int"))
                       .alias("family"), top.alias("probability"))


def _inner(words: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def _needed(notices: list[list[str]], least: list[int]) -> list[str]:
    """Words of which one is in any ``least`` pairs of a notice; long words first, as they are rare."""
    chosen: list[str] = []
    for pairs, need in zip(notices, least):
        left = [p.split() for p in pairs]
        while len(left := [p for p in left if not set(p) & set(chosen)]) >= need:
            chosen.append(max({w for p in left for w in p}, key=lambda w: (len(w), w)))
    return chosen


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def stretches(docs: DataFrame) -> DataFrame:
    """Where a text repeats a notice: ``doc_id, paragraph, words, family, similarity``.

    A paragraph is a run of lines that have words.  Windows of one and a half notices are laid over it,
    half a notice apart, so each stretch as long as the notice lies whole in one of them.  ``similarity``
    is the share of the notice's word pairs that the window has, whatever else stands there; a window
    that overlaps with a better one of the same notice does not count.  ``words`` run from the first to
    the last of these pairs, and ``paragraph`` is the line that has most of them.
    """
    notices = [(r.family, [p for p in r.pairs if not p.startswith("^ ") and not p.endswith(" $")])
               for r in _notices(docs.sparkSession).collect()]     # the fixed notices
    least = [math.ceil(SIMILAR * len(pairs) - 1e-9) for _, pairs in notices]
    every = F.lit(sorted({p for _, pairs in notices for p in pairs}))
    # enough pairs of a notice hold one of a few words, which most texts do not have
    low = F.lower("text")
    texts = docs.select("doc_id", text_of().alias("text")).filter(_any([
        low.contains(w) for w in _needed([pairs for _, pairs in notices], least)]))
    # what has fewer pairs of a notice in the whole text has them in no window either
    own = _once(words_of("text"), lambda w: F.when(F.size(w) > 1, F.array_intersect(every, _inner(w))))
    hits = texts.select("doc_id", "text", own.alias("_hits")).filter(F.size("_hits") >= min(least))
    near = F.array_compact(F.array(*[
        F.when(F.size(F.array_intersect("_hits", F.lit(pairs))) >= need, F.lit(k))
        for k, ((_, pairs), need) in enumerate(zip(notices, least))]))
    found = hits.select("doc_id", "text", F.explode(near).alias("notice"))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("notice") + 1)
    told = found.withColumn("_lines", F.transform(
        F.split("text", r"\r\n|\n|\r"), lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    # a line without words stands as one empty word, which is in no notice
    told = told.select(
        "doc_id", F.xxhash64("text").alias("_text"), "notice", of([p for _, p in notices]).alias("_pairs"),
        of([(len(p) + 1) // 2 for _, p in notices]).alias("_step"),
        F.flatten(F.transform("_lines", lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(""))))).alias("_words"),
        F.flatten(F.transform("_lines", lambda w, k: F.array_repeat(k, F.greatest(F.size(w), F.lit(1)).cast("int")))).alias("_line"))
    width = of([len(p) + 1 for _, p in notices]) + F.col("_step")
    cut = F.transform(F.sequence(F.lit(1), F.size("_words"), F.col("_step")), lambda at: F.struct(
        at.alias("at"), F.slice("_words", at, width).alias("words"), F.slice("_line", at, width).alias("line")))
    cut = told.select("doc_id", "_text", "notice", "_pairs", "_step", F.explode(cut).alias("_w")).select(
        "doc_id", "_text", "notice", "_pairs", "_step", "_w.*")
    share = F.size(F.array_intersect("_pairs", _inner(F.col("words")))) / F.size("_pairs")
    cut = cut.filter(F.size("words") > 1).withColumn("similarity", share).filter(F.col("similarity") >= SIMILAR)
    beside = Window.partitionBy("doc_id", "_text", "notice").orderBy(
        F.floor((F.col("at") - 1) / F.col("_step"))).rangeBetween(-2, 2)
    cut = cut.withColumn("_best", F.max("similarity").over(beside)).filter(F.col("similarity") == F.col("_best"))
    common = F.filter(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.array_contains(
        F.col("_pairs"), F.concat(F.element_at("words", k), F.lit(" "), F.element_at("words", k + 1))))
    cut = cut.withColumn("_at", common)
    lines = F.transform("_at", lambda k: F.element_at("line", k))
    most = F.array_max(F.transform(F.array_distinct(lines), lambda n: F.struct(
        F.size(F.filter(lines, lambda m: m == n)).alias("n"), (-n).alias("line"))))
    return cut.select("doc_id", (-most["line"]).cast("int").alias("paragraph"), F.slice(
        "words", F.array_min("_at"), F.array_max("_at") - F.array_min("_at") + 2).alias("words"),
        of([f for f, _ in notices]).alias("confirmed"), "similarity")


def scan(docs: DataFrame) -> DataFrame:
    """Licence paragraphs: ``doc_id, paragraph, family, probability, similarity``.

    ``paragraph`` is the number, from 0, of the line with most of the notice.  A stretch that repeats
    enough of a notice counts when the classifier's likeliest family passes the calibrated bound, and
    one that repeats a notice in full counts whatever the classifier says.  A line has the family of its nearest notice, and those of notices that it repeats in full.  Null
    and empty texts have no paragraphs.  Rows that repeat are scanned each; rows with one ``doc_id``
    and the same finding give one row.  Only ``doc_id`` and ``text`` are read.
    """
    model, bound = train(docs)
    told = _best(stretches(docs), model).filter((F.col("probability") >= bound) | (F.col("similarity") == 1))
    found = (told.groupBy("doc_id", "paragraph", F.col("confirmed").alias("family"))
             .agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity")))
    place = F.row_number().over(Window.partitionBy("doc_id", "paragraph").orderBy(
        F.desc("similarity"), F.desc("family")))
    return (found.withColumn("_place", place).filter((F.col("_place") == 1) | (F.col("similarity") == 1))
            .drop("_place"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
SQL: dict[str, str] = {}
