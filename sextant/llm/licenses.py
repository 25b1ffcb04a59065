"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

`phrases` finds every place where a license phrase's words stand consecutively. `template_matches` is the join: a text
is cut into overlapping blocks of words; a block matches a template when it holds at least THRESHOLD of the template's
distinct words. Template words are ordered by how many documents of the whole corpus hold them, rarest first. A block
that reaches the threshold must hold one of a template's first |T| - ceil(t|T|) + 1 words (prefix filter), must have at
least ceil(t|T|) words (length filter), and, where its first shared prefix word is the template's i-th and the j-th of the K
template words that it holds, can share at most min(|T| - i, K - j) words (positional filter). What is left is verified exactly; whether it
holds the template's own words that tell licenses apart (TELLING) is told of each match and decides about labels, not about matches. The templates are a fixed list, so their index is a bounded broadcast; documents are
never shuffled with their text.

Only DataFrame functions. Edge cases: a null text counts as empty and has no words, places or labels; empty tables give
empty results; repeated rows each get their own result row; other columns are ignored; ids may be null or repeated.
Texts of any length are cut into blocks whole. Of phrases that overlap each place counts; the best containment is the
score, whichever template has it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase and label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wordings of common notices, in words, with the label each stands for.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Words without which a block is not a template's, however much of it they share: they tell licenses of like wording apart.
TELLING = {"mit", "apache", "gnu", "mozilla", "nc", "noncommercial"}
THRESHOLD = 0.8
#: Words that separate: everything in ASCII that is no digit or letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """' w1 w2 ... ' in lower case; ' ' where there are no words.

    Lower-casing all letters equals lower-casing A-Z here: no letter outside ASCII becomes one of a phrase's letters,
    and word borders stay.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(norm: Column) -> Column:
    return (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long")


def phrases(docs: DataFrame, norm: Column | None = None, found: dict[str, str] = PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_list (sorted labels) to docs with a text column."""
    any_phrase = "|".join(sorted(found, key=len, reverse=True))
    n = norm if norm is not None else spaced(F.col("text"))
    with_norm = docs.withColumn("_norm", n)
    c = F.col("_norm")
    hit = c.rlike(f" (?:{any_phrase}) ")
    before_first = F.regexp_extract(c, f"(?s)^(.*?) (?:{any_phrase}) ", 1)
    before_last = F.regexp_extract(c, f"(?s)^(.*) (?:{any_phrase}) ", 1)
    # what stands before a hit is ' w1 .. wk' (or empty): k words, k spaces
    place = lambda before: (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("long")
    labels = F.sort_array(F.array_distinct(F.filter(
        F.array(*[F.when(c.contains(f" {p} "), F.lit(label)) for p, label in found.items()]), lambda x: x.isNotNull())))
    return (
        with_norm.withColumn("n_words", count_words(c))
        .withColumn("n_base", F.when(hit, F.size(F.regexp_extract_all(c, F.lit(f"(?<= )(?:{any_phrase})(?= )"), F.lit(0)))).otherwise(0).cast("long"))
        .withColumn("first_word", F.when(hit, place(before_first)))
        .withColumn("last_word", F.when(hit, place(before_last)))
        .withColumn("base_list", F.when(hit, labels).otherwise(F.array().cast("array<string>")))
        .drop("_norm")
    )


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """tid, label, words (distinct): one row per template."""
    rows = [(i, label, sorted(set(text.split()))) for i, (label, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "tid int, label string, words array<string>")


def word_frequency(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, df: how many documents of the whole corpus hold each template word (0 where none does)."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(F.split(spaced(F.col("text")), " "), known)).alias("word"))
    counted = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    base = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    return base.join(counted, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def ordered_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """(label, distinct words, rarest first) of each template, and all their words in that order. The vocabulary is fixed, so a few hundred counts come to the driver."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    df = {r["word"]: r["df"] for r in word_frequency(docs, vocabulary).collect()}
    rarest = lambda words: sorted(words, key=lambda w: (df[w], w))
    return [(label, rarest(set(text.split()))) for label, text in templates], rarest(vocabulary)


def template_matches(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Every block that meets the threshold: doc_id, text_hash, block, tid, label, containment, told (whether it holds the template's telling words).

    Blocks are windows of twice the longest template's words, one starting every longest-template's words, so any run
    of words as long as a template lies whole in a block.
    """
    spark = docs.sparkSession
    ordered, vocabulary = ordered_templates(docs, templates)
    longest = max(len(text.split()) for _, text in templates)
    need = [math.ceil(round(threshold * len(words), 9)) for _, words in ordered]
    prefix = [(words[i], tid, i) for tid, (_, words) in enumerate(ordered) for i in range(len(words) - need[tid] + 1)]
    first = sorted({w for w, _, _ in prefix})
    index = spark.createDataFrame(prefix, "word string, tid int, at int")
    table = spark.createDataFrame(
        [(tid, label, words, need[tid], [w for w in words if w in TELLING]) for tid, (label, words) in enumerate(ordered)], "tid int, label string, words array<string>, need int, telling array<string>")

    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(F.trim(spaced(F.col("text"))), " ").alias("w"))
    held = F.array(*[F.lit(w) for w in first])
    d = d.where(F.arrays_overlap("w", held))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - longest) / longest).cast("int")))
    blocks = d.select("doc_id", "text_hash", "w", F.explode(starts).alias("block"))
    blocks = blocks.select("doc_id", "text_hash", "block", F.array_distinct(F.slice("w", F.col("block") * longest + 1, F.lit(2 * longest))).alias("b"))
    ranked = F.array(*[F.lit(w) for w in vocabulary])
    blocks = blocks.withColumn("known", F.array_intersect(ranked, F.col("b")))
    tokens = blocks.select("doc_id", "text_hash", "block", "b", "known", F.explode(F.array_intersect("known", held)).alias("word"))
    found = tokens.join(F.broadcast(index), "word").join(F.broadcast(table), "tid")
    # words of any template in their global order: what follows a shared word on either side bounds what is shared
    left = F.size("known") - (F.array_position("known", F.col("word")) - 1)
    found = found.where((F.size("b") >= F.col("need")) & (F.least(F.size("words") - F.col("at"), left) >= F.col("need")))
    # a pair that shares several prefix words comes once: at the first of them in the template's order
    first_shared = F.array_position(F.transform("words", lambda x: F.array_contains(F.col("b"), x)), True) - 1
    found = found.where(F.col("at") == first_shared)
    shared = F.size(F.array_intersect("b", "words"))
    told = F.size(F.array_except("telling", "b")) == 0
    return found.withColumn("shared", shared).where(F.col("shared") >= F.col("need")).select(
        "doc_id", "text_hash", "block", "tid", "label", (F.col("shared") / F.size("words")).alias("containment"), told.alias("told"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, found: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels: base labels and those of matched templates, distinct, sorted, comma-joined. score: the best containment, or
    1.0 where a phrase stands, or 0.0.
    """
    docs = docs.select("doc_id", "text")
    base = phrases(docs, found=found).withColumn("text_hash", F.xxhash64("text")).drop("text")
    matched = template_matches(docs, threshold, templates).where("told").groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = base.join(matched, base["doc_id"].eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    all_labels = F.sort_array(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"))
