"""License notices by diagonal voting over word k-grams (operator 6).

DataFrame operations only.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Words of a k-gram.
K = 3
#: Diagonals at most so far apart (words put in or left out) are one span.
NEAR = 2
#: Share of a template's words that a span must hold.
COVER = 0.75
#: k-grams of templates that are sent to the rows; a longer list is joined by hash.
SENT = 100_000
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Exact phrases; every place counts.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Notices that are found with changes: label, then one text or several.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial license",
    ),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike license",),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}


def words_of(text: str) -> list[str]:
    """The words of a template: what ``_words`` gives for a text."""
    return [w for w in re.split(BETWEEN, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def _words(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def template_grams(spark: SparkSession, templates: Mapping[str, tuple[str, ...]], k: int) -> DataFrame:
    """``(h, w0.., template, label, at, n)``: the k-grams of the templates, whose
    number is that of the templates' words; at most SENT of them are sent to the rows."""
    rows, number = [], 0
    for label, texts in templates.items():
        for text in texts:
            w = words_of(text)
            for at in range(len(w) - k + 1):
                rows.append((*w[at : at + k], number, label, at, len(w)))
            number += 1
    names = [f"w{i}" for i in range(k)]
    schema = ", ".join([f"{c} string" for c in names] + ["template int, label string, at int, n int"])
    grams = spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64(*names))
    return F.broadcast(grams) if len(rows) <= SENT else grams


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None, phrases: Mapping[str, str] | None = None, k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """License labels of each row of ``docs(doc_id, text)``.

    One row each: ``(doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans)``. Words are runs of digits, ASCII letters (lower-cased)
    and characters beyond ASCII. ``base_labels`` are those of the exact
    ``phrases``, n_base all their places, first and last their outermost starts.
    Every rolling k-gram of the whole text is joined by its hash to the template
    positions, the k words compared; hits are counted by offset diagonal (text
    position less template position), diagonals at most ``near`` apart are merged,
    and a merged span is verified by the template words that its hits cover: with
    a share of ``cover`` its label counts. ``score`` is the largest such share (1
    for an exact phrase), 0 without a label; ``spans`` has label, first and last
    word and share of each. A null text is empty; label lists are sorted,
    comma-joined and empty without a hit; repeated rows stay rows of their own.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    grams = template_grams(docs.sparkSession, templates, k)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("w"))
    placed = own.select("doc_id", "row", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    after = lambda i: F.get("w", F.col("pos") + i)
    begins = []  # several phrases may begin at one place
    for label, phrase in phrases.items():
        p = words_of(phrase)
        here = F.col("word") == p[0]
        for i, word in enumerate(p[1:], 1):
            here = here & (after(i) == word)
        begins.append((here, label))
    any_ = functools.reduce(lambda a, b: a | b, (here for here, _ in begins), F.lit(False))
    # a text of labels: a lambda here would end the generated code in which words never become rows with all words
    base = F.when(any_, F.concat_ws("\x00", *[F.when(here, label) for here, label in begins]))
    gram = [F.col("word"), *[after(i) for i in range(1, k)]]
    # a place without a gram meets none: its words are null; its hash only spreads it
    hash_ = F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(*gram)).otherwise(F.xxhash64("row", "pos"))
    placed = placed.select("doc_id", "row", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), base.alias("base"), hash_.alias("gh"), *[g.alias(f"g{i}") for i, g in enumerate(gram)])
    on = F.col("gh") == F.col("h")
    for i in range(k):
        on &= F.col(f"g{i}") == F.col(f"w{i}")
    met = placed.join(grams, on, "left").where((F.col("pos") == 0) | F.col("base").isNotNull() | F.col("template").isNotNull())
    # one line for each diagonal, and one for the rest of a row
    covered = F.sequence(F.col("at"), F.col("at") + k - 1)
    lines = met.groupBy("row", "doc_id", "n_words", "template", "label", "n", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("template").isNotNull(), covered)))).alias("cover"),
        F.min("pos").alias("low"), (F.max("pos") + k - 1).alias("high"),
        F.array_distinct(F.flatten(F.collect_list(F.transform(F.split("base", "\x00"), lambda b: F.struct(F.col("pos").alias("pos"), b.alias("base")))))).alias("base"),
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    begins = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= near, 0).otherwise(1)
    runs = lines.withColumn("span", F.sum(begins.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "doc_id", "n_words", "template", "label", "n", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("cover")))).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"), F.flatten(F.collect_list("base")).alias("base")
    )
    share = F.col("covered") / F.col("n")
    found = F.when(F.col("template").isNotNull() & (share >= cover), F.struct(F.col("low").cast("long").alias("first"), F.col("high").cast("long").alias("last"), "label", share.alias("share")))
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_list(found)).alias("spans"), F.array_distinct(F.flatten(F.collect_list("base"))).alias("base")
    )
    at = F.transform("base", lambda b: b["pos"])
    base_labels = F.array_distinct(F.transform("base", lambda b: b["base"]))
    labels = F.array_union(base_labels, F.transform("spans", lambda s: s["label"]))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    best = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(labels).alias("labels"), best.alias("score"), "spans",
    )
