"""Licence scan: sparse word n-gram logistic regression over paragraphs, confirmed by template comparison."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.llm.common import lower_ascii, split_words

# A dot belongs to a word only before a letter or digit.
NOT_IN_WORDS = r"(?:[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]|\.(?![0-9A-Za-z]))+"
WORD = r"[^\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]|[A-Z]"
BLANK = r"\n[ \t\r]*\n"
# The corpus weighs as much in a fit as so many rows; one in so many of its paragraphs may look like a licence.
NEGATIVE_ROWS = 2000
# A paragraph with as many word pairs of the notices in a row is no example of ordinary text.
RUN = 3
# Share of a template's word pairs, and of those that no other family's templates have, that confirms a family, within
# a place of the text of twice the template's length.
CONFIRM = 0.6
# One in so many families is left out of a fit, to see how likely licences of unseen families look.
FOLDS = 3
NONE = "none"

# Notices by which texts name their licence, by family.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "Licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Apache License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "Released into the public domain under CC0 1.0."),
)
LABELS = [NONE] + sorted({f for f, _ in TEMPLATES})
# What surrounds a notice, for training.
BEFORE = ("", "Copyright 2020 the authors. ", "All of this document: ", "Note. ")
AFTER = ("", " See the file for details.", " All rights reserved otherwise.")


def _words(text: Column) -> Column:
    return split_words(lower_ascii(text), NOT_IN_WORDS)


def _pairs(rows: DataFrame, words: str) -> DataFrame:
    """Replace the words by hashes of their neighbouring pairs."""
    w = F.col(words)
    # The lambda must not refer to the words: Spark may put the split in its place, once for every pair.
    pairs = F.slice(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.size(w) - 1, F.lit(0)))
    return rows.withColumn("pairs", pairs).drop(words)


def notices(spark: SparkSession) -> DataFrame:
    """(family, pairs, weight): the templates in some surroundings."""
    rows = [(f, b + t + a) for f, t in TEMPLATES for b in BEFORE for a in AFTER]
    named = spark.createDataFrame(rows, "family string, t string")
    return _pairs(named.select("family", _words(F.col("t")).alias("w")), "w").select("family", F.array_distinct("pairs").alias("pairs"), F.lit(1.0).alias("weight"))


def notice_places(lines: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, at, g): the places of the ``known`` pairs among the words ``w`` of all lines.

    Words are rows with their successor, hashed in generated code; a lambda over the words is interpreted, which took
    most of the query's time.
    """
    each = lines.select(*keys, "w", F.posexplode("w").alias("at", "x"))
    pairs = each.select(*keys, "at", "x", F.get("w", F.col("at") + 1).alias("y")).where("y is not null")
    return pairs.select(*keys, "at", F.xxhash64("x", "y").alias("g")).join(F.broadcast(known), "g").select(*keys, "at", "g")


def ordinary(spark: SparkSession, sets: DataFrame, total: int) -> DataFrame:
    """(pairs, n): all ordinary paragraphs of the corpus, counted by the notice pairs that they hold.

    Left out are paragraphs with ``RUN`` pairs of notices in a row or with all pairs of a template that is shorter.
    ``total`` is the number of paragraphs, ``sets`` those with a pair.
    """
    short = [r["pairs"] for r in _pairs(spark.createDataFrame(TEMPLATES, "f string, t string").select(_words(F.col("t")).alias("w")), "w").distinct().collect()]
    is_notice = F.lit(False)
    for pairs in short:
        if 0 < len(pairs) < RUN:
            is_notice = is_notice | (F.size(F.array_except(F.array(*[F.lit(g) for g in pairs]), "pairs")) == 0)
    counted = sets.where(~F.col("in_a_row") & ~is_notice).groupBy("pairs").agg(F.count("*").alias("n"))
    without = spark.createDataFrame([([], max(0, total - sets.count()))], "pairs array<long>, n long").where("n > 0")
    return materialize(counted.unionByName(without), "ordinary")


def training_rows(spark: SparkSession, plain: DataFrame, negatives: int) -> DataFrame:
    """(family, pairs, weight): the notices, and the ordinary paragraphs, which weigh ``negatives`` rows in all."""
    total = plain.agg(F.sum("n")).first()[0] or 1
    rows = plain.select(F.lit(NONE).alias("family"), "pairs", (F.col("n") * (negatives / total)).alias("weight"))
    return notices(spark).unionByName(rows)


def fit(spark: SparkSession, train: DataFrame) -> DataFrame:
    """(g, z): for each weighted word pair its weight for every class of ``train`` in turn; the null pair is the bias."""
    named = train.withColumn("pairs", F.col("pairs").cast("array<string>"))
    vocabulary = CountVectorizer(inputCol="pairs", outputCol="x", binary=True, minDF=2.0, vocabSize=1 << 13).fit(named)
    numbered = spark.createDataFrame(list(enumerate(LABELS)), "y int, family string")
    model = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=0.002, elasticNetParam=0.9, maxIter=40, standardization=False
    ).fit(vocabulary.transform(named.join(F.broadcast(numbered), "family")))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    # A class without rows ends with the bias of a class that never is.
    there = {r[0] for r in train.select("family").distinct().collect()}
    bias = [float(b) if f in there else -1e3 for f, b in zip(LABELS, list(bias) + [-1e3] * len(LABELS))]
    matrix = list(matrix) + [0 * matrix[0]] * (len(LABELS) - len(matrix))
    rows = [(int(g), [float(m[i]) for m in matrix]) for i, g in enumerate(vocabulary.vocabulary) if max(abs(m[i]) for m in matrix) > 1e-9]
    return spark.createDataFrame([*rows, (None, bias)], "g long, z array<double>")


def scored(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """(keys, like): the probability that a row is a licence's, of each row with a weighted pair among its distinct pairs."""
    names = [f"w{k}" for k in range(len(LABELS))]
    flat = weights.select("g", *[F.col("z")[k].alias(n) for k, n in enumerate(names)])
    bias = flat.where("g is null").select(*[F.col(n).alias(f"b{n}") for n in names])
    hit = rows.select(*keys, F.explode("pairs").alias("g")).join(F.broadcast(flat.where("g is not null")), "g")
    sums = hit.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]).crossJoin(F.broadcast(bias))
    z = [F.col(n) + F.col(f"b{n}") for n in names]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    return sums.select(*keys, (1 - F.exp(z[LABELS.index(NONE)] - top) / total).alias("like"))


def licence_likeness(spark: SparkSession, train: DataFrame, plain: DataFrame, negatives: int) -> float:
    """The least probability at which a paragraph counts as a licence's, of a known family or not.

    Some families are left out; what the fit without them says of their notices is how likely unseen licences look. The
    threshold lies between the first tenth of that and what one in ``negatives`` of the ordinary paragraphs reaches,
    by the counts of all of them, and not below the latter.
    """
    left_out = (F.col("family") != NONE) & (F.pmod(F.crc32("family"), F.lit(FOLDS)) == 0)
    weights = fit(spark, train.where(~left_out))
    numbered = materialize(train.where(left_out).select(F.monotonically_increasing_id().alias("row"), "pairs"), "train")
    unseen = scored(numbered, ["row"], weights).agg(F.coalesce(F.percentile_approx("like", 0.1, 10000), F.lit(1.0))).first()[0]
    numbered = materialize(plain.select(F.monotonically_increasing_id().alias("row"), "pairs", "n"), "ordinary")
    steps = scored(numbered, ["row", "n"], weights).groupBy(F.round("like", 4).alias("like")).agg(F.sum("n").alias("n"))
    steps = materialize(steps, "likeness")  # at most 10,001 rows
    total, met = plain.agg(F.sum("n")).first()[0] or 0, steps.agg(F.sum("n")).first()[0] or 0
    most = steps.agg(F.percentile("like", 1 - total / negatives / met, F.col("n"))).first()[0] if total / negatives < met else 0.0
    return min(max((most + unseen) / 2, most, 0.05), 0.9)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", negatives: int = NEGATIVE_ROWS) -> DataFrame:
    """Licence families named in each whole text.

    Paragraphs are runs of lines that are not blank. A multinomial logistic regression with an L1 penalty on word pairs of
    the notices is fitted on the templates in varied surroundings and, as class ``none``, on all ordinary paragraphs of the
    corpus, counted by the notice pairs that they hold; together they weigh ``negatives`` rows. The texts are read once for
    the places of notice pairs, which are a small table; all that follows works on it. A paragraph without a weighted pair
    has the bias alone, which is ``none``, and costs no row.

    A paragraph counts as a licence's if the probability of all families together reaches a threshold that is calibrated
    on families left out of a fit. Of such a paragraph every family stands of which a template is found in one place
    with at least 60 % of its word pairs, and of those pairs that no other family has; if none is, the licence is unknown.

    Returns doc_id, text_hash, n_paragraphs (with words), n_licensed, n_unknown, families (sorted, comma-joined): a row
    per different (doc_id, text), null ids included. Null and empty texts have no paragraphs. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("t")
    )
    counted = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), BLANK), lambda p: p.rlike(WORD))).cast("long")
    per_doc = materialize(base.select("doc_id", "text_hash", "row", counted.alias("n_paragraphs")).distinct(), "documents")

    keys = ["row", "line"]
    known = materialize(notices(spark).select(F.explode("pairs").alias("g")).distinct(), "known")
    lines = base.select("row", F.posexplode(F.split("t", BLANK)).alias("line", "p")).select(*keys, _words(F.col("p")).alias("w"))
    hits = materialize(notice_places(lines, keys, known), "hits")
    places = F.sort_array(F.collect_set("at"))
    sets = hits.groupBy(*keys).agg(F.sort_array(F.collect_set("g")).alias("pairs"), places.alias("at"))
    later = F.slice("at", RUN, F.greatest(F.size("at"), F.lit(1)))
    in_a_row = F.exists(F.zip_with("at", later, lambda x, y: y - x), lambda d: F.coalesce(d, F.lit(0)) == RUN - 1)
    sets = materialize(sets.select(*keys, "pairs", in_a_row.alias("in_a_row")), "sets")

    plain = ordinary(spark, sets, per_doc.agg(F.sum("n_paragraphs")).first()[0] or 0)
    train = materialize(training_rows(spark, plain, negatives), "train")
    accept = licence_likeness(spark, train, plain, negatives)
    near = materialize(scored(sets, keys, fit(spark, train)).where(F.col("like") >= accept), "paragraphs")

    shown = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, f string, t string")
    shown = _pairs(shown.select("template", "f", _words(F.col("t")).alias("w")), "w").select("template", "f", F.explode("pairs").alias("g")).distinct()
    owned = shown.groupBy("g").agg((F.count_distinct("f") == 1).alias("own"))
    shown = materialize(shown.join(owned, "g"), "templates")
    sizes = shown.groupBy("template").agg(F.count("*").alias("all"), F.count_if("own").alias("all_own"))
    shown = F.broadcast(shown.join(sizes, "template"))
    texts = hits.join(near.select(*keys), keys)
    # Places overlap by half, so that a stretch of a template's length lies in one of them.
    half = F.col("at") / F.col("all")
    hits = texts.join(shown, "g").withColumn("place", F.explode(F.array(2 * F.floor(half / 2), 2 * F.floor((half + 1) / 2) - 1)))
    confirmed = (
        hits.groupBy(*keys, "template", "place", "f", "all", "all_own", "g", "own").agg(F.lit(1).alias("one"))
        .groupBy(*keys, "template", "place", "f", "all", "all_own")
        .agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"))
        .where((F.col("n") >= CONFIRM * F.col("all")) & (F.col("n_own") >= CONFIRM * F.col("all_own")))
        .groupBy(*keys).agg(F.collect_set("f").alias("f"))
    )
    verdict = near.join(confirmed, keys, "left").groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("f"),
        F.count("f").alias("n_licensed"),
        F.count_if(F.col("f").isNull()).alias("n_unknown"),
    )
    return per_doc.join(verdict, "row", "left").select(
        "doc_id", "text_hash", "n_paragraphs",
        F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        F.coalesce(F.concat_ws(",", "f"), F.lit("")).alias("families"),
    )
