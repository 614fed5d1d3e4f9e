"""License scans: exact set-similarity join of text blocks with license templates, with DataFrame functions only.

Words are runs of letters, digits and characters beyond ASCII, in lower case for A-Z. Besides the places where fixed
phrases stand, every line of a text is a block, and a block meets a template when it holds at least ``THRESHOLD`` percent
of the template's different words.

The words of all templates are ordered by the number of documents they occur in, rarest first, counted over the whole
corpus; only words of templates can match, so the order and all filters need no others. With overlap at least ``need``:

* prefix: a block and a template that meet share one of the template's first ``size - need + 1`` words, and it is among the
  block's first ``held - need + 1`` template words;
* length: the block holds at least ``need`` different template words;
* position: the words not behind the first shared one cannot be shared, which bounds the overlap.

What passes is verified by intersecting the sets. Templates are a fixed list, so they are broadcast and their counts, one
per word, are collected. Texts never meet a shuffle; only blocks that pass the prefix filter and slim rows per document do.

Defined results: a null text is empty: no words, no labels, score 0, null positions; equal rows get equal results; lines
without template words meet none; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases, whose places are the base, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license notices, by the label that a block meeting them gets.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 80  # percent of a template's different words

#: What separates words, for a regular expression.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z; other letters change case too, which no result shows, but for the one that would become ASCII."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"[^{GAP}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; capitals are letters here, as no case has changed."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _set_of(text: str) -> list[str]:
    """The different words of a template, which is plain ASCII."""
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text in templates for w in _set_of(text)})


def document_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Number of documents of the whole corpus that hold each word of the templates; one row per such word is collected."""
    held = F.array_intersect(words(docs["text"]), F.array(*map(F.lit, vocabulary(templates))))
    return {r["word"]: r["count"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()}


def _among(words_: list[str]) -> str:
    """A pattern that finds any of some words, standing alone."""
    return f"(?<![^{GAP}])(?:{'|'.join(words_)})(?![^{GAP}])"


def _index(spark: SparkSession, sets: list[tuple[int, str, list[int], int]]) -> DataFrame:
    """The inverted index of the templates' prefixes: a row for each token in one, with its place and the template."""
    rows = [F.struct(F.lit(rank).alias("token"), F.lit(place).alias("place"), F.lit(i).alias("template"),
                     F.lit(label).alias("label"), F.array(*map(F.lit, ranks)).alias("ranks"), F.lit(need).alias("need"))
            for i, label, ranks, need in sets for place, rank in enumerate(ranks[:len(ranks) - need + 1])]
    return spark.range(1).select(F.inline(F.array(*rows)))


def matching_blocks(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, block, template, label, overlap, size) for every line that meets a template; lines count from 0."""
    frequency = document_frequency(docs, templates)
    order = sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    sets = []
    for i, (label, text) in enumerate(templates):
        ranks = sorted(rank[w] for w in _set_of(text))
        sets.append((i, label, ranks, -(-threshold * len(ranks) // 100)))
    least = min(need for *_, need in sets)
    some = _among(sorted({order[r] for _, _, ranks, need in sets for r in ranks[:len(ranks) - need + 1]}))
    # without any word of a prefix, a document has no block to look at, and a block meets nothing
    near = docs.select("doc_id", "text").where(lower_ascii(F.col("text")).rlike(some))
    block = near.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("block", "line"))
    block = block.where(lower_ascii(F.col("line")).rlike(some))
    rank_of = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    known = F.array_intersect(words(F.col("line")), F.array(*map(F.lit, order)))
    held = F.array_sort(F.transform(known, lambda w: F.element_at(rank_of, w)))
    block = block.select("doc_id", "text_key", "block", held.alias("held")).where(F.size("held") >= least)
    token = block.select("*", F.posexplode("held").alias("spot", "token"))
    met = token.join(F.broadcast(_index(docs.sparkSession, sets)), "token")  # bounded by the fixed list of templates
    met = met.where((F.size("held") >= F.col("need")) & (F.col("spot") <= F.size("held") - F.col("need")))
    rest = F.least(F.size("ranks") - F.col("place"), F.size("held") - F.col("spot"))
    met = met.where(rest >= F.col("need"))  # holds at the first shared word of every pair that meets
    once = met.groupBy("doc_id", "text_key", "block", "template", "label", "need", "held", "ranks").agg(F.lit(1))
    overlap = F.size(F.array_intersect("held", "ranks"))
    return once.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")) \
        .select("doc_id", "text_key", "block", "template", "label", "overlap", F.size("ranks").alias("size"))


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, text_key, n_words, places): for each phrase, an array of the word numbers where it starts."""
    apart = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the case is still that of the text
    some = "(?i)" + "|".join(apart.join(p.split()) for p in phrases)
    told = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("n_words"),
                       F.when(F.col("text").rlike(some), words(F.col("text"))).alias("words"))

    def places(phrase: str) -> Column:
        parts, found = phrase.split(), F.col("words")
        starts = F.sequence(F.lit(0), F.size(found) - len(parts))

        def here(i: Column) -> Column:
            same = F.get(found, i) == parts[0]
            for j, part in enumerate(parts[1:], 1):
                same = same & (F.get(found, i + j) == part)
            return same
        return F.when(F.size(found) >= len(parts), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))

    return told.select("doc_id", "text_key", "n_words", *[places(p).alias(f"at_{i}") for i, p in enumerate(phrases)])


def scan(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: words, places of phrases, base labels, all labels and a score.

    The score is 1 with a place, else the largest share of a template's words that one block holds, else 0.
    """
    base = phrase_places(docs, phrases)
    met = matching_blocks(docs, templates, threshold).groupBy("doc_id", "text_key") \
        .agg(F.collect_set("label").alias("met"), F.max(F.col("overlap") / F.col("size")).alias("share"))  # labels are fixed
    same = F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_key") == F.col("m.text_key"))
    told = base.alias("b").join(met.alias("m"), same, "left").select("b.*", "met", "share")
    at = [F.col(f"at_{i}") for i in range(len(phrases))]
    every = F.concat(*at)
    labels = F.array_compact(F.array(*[F.when(F.size(a) > 0, label) for a, label in zip(at, phrases.values())]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return told.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
