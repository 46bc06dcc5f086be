"""License scans by diagonal voting, with DataFrame functions only.

Every run of K words of every text is hashed. Runs whose hash no template has go at once; the others are
joined with the K-word runs of the templates (a fixed, small table). A hit at word p of the text and word t of the template votes for the diagonal p - t. A
phrase stands where its diagonal has all its votes. Of a longer template the votes of neighbouring
diagonals (words put in or left out) are merged into a span, and the label counts if the span covers
enough of the template. Each hit is checked on the words themselves, so hash collisions do no harm.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import row_key, written

K = 3
#: Diagonals at most this many words apart are one span.
SHIFT = 8
#: Share of a template's K-word runs that a span must show.
COVERAGE = 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening passages of public licenses and their labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> list[tuple]:
    """(template, label, base, at, total, words) for each K-word run of the phrases and templates."""
    out = []
    texts = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, t in templates.items()]
    for k, (text, label, base) in enumerate(texts):
        w = words_of(text)
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        out += [(k, label, base, t, len(w) - K + 1, w[t : t + K]) for t in range(len(w) - K + 1)]
    if len(out) > 20_000:
        raise ValueError("templates of more than 20,000 words are not broadcast")
    return out


def _template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = spark.createDataFrame(rows, "template int, label string, base boolean, at int, total int, gram array<string>")
    return table.withColumn("h", F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(K)]))


def _lower(text: Column) -> Column:
    """A-Z lower-cased; null is empty. In plain ASCII texts ``lower`` does the same, faster."""
    text = F.coalesce(text, F.lit(""))
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def words(text: str = "text") -> Column:
    """Words of a text column, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(_lower(F.col(text)), F.lit(WORD), 0)


def hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, _th, n_words, hits) of each row: how many words it has and, of its K-word runs, the places
    and words of those whose hash is in ``table``. Texts are cut into words once; the work is linear in them."""
    known = [r.h for r in table.select("h").distinct().collect()]  # at most 20,000 runs of the templates
    run = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(K)])

    def found(w: Column) -> Column:
        places = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
        some = F.filter(places, lambda i: run(w, i).isin(known))
        near = F.transform(some, lambda i: F.struct(i.alias("p"), F.slice(w, i + 1, K).alias("words")))
        return F.struct(F.size(w).cast("long").alias("n_words"), near.alias("hits"))

    return docs.select(*row_key(docs), let(words(), found).alias("f")).select("doc_id", "_th", "f.n_words", "f.hits")


def diagonals(found: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, _th, template, label, base, total, diagonal, votes, places, first, last) from ``hits``: the
    votes of each diagonal, the template's words that they stand for and the text's words from first to last
    that gave them. Rows that are copies of one another vote once."""
    rows = found.filter(F.size("hits") > 0).select("doc_id", "_th", F.explode("hits").alias("x")).select("doc_id", "_th", "x.p", "x.words")
    rows = rows.withColumn("h", F.xxhash64(*[F.get("words", F.lit(j)) for j in range(K)]))
    voting = rows.join(F.broadcast(table), "h").filter(F.col("words") == F.col("gram"))
    return voting.groupBy("doc_id", "_th", "template", "label", "base", "total", (F.col("p") - F.col("at")).alias("diagonal")).agg(
        F.count_distinct("at").alias("votes"), F.collect_set("at").alias("places"), F.min("p").alias("first"), (F.max("p") + K - 1).alias("last")
    )


def spans(voted: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Merge neighbouring diagonals of each text and template: (..., first, last, covered), covered being
    the share of the template's runs that voted: a run that votes on several diagonals counts once."""
    by = Window.partitionBy("doc_id", "_th", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > shift, F.lit(True))
    return (
        voted.withColumn("_new", fresh.cast("int"))
        .withColumn("span", F.sum("_new").over(by))
        .groupBy("doc_id", "_th", "template", "label", "base", "total", "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("covered", F.col("votes") / F.col("total"))
    )


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base (places where a phrase stands),
    first_word and last_word (their least and greatest start; null without any), base_labels and labels
    (with those of the templates covered by ``coverage`` or more; distinct, sorted, comma-joined, ''
    for none) and score (1 with a phrase, else the best covered share of a template).

    Words are lower-cased runs of letters and digits; null and blank texts have none. Rows that repeat
    id and text get the same results.
    """
    table = _template_table(docs.sparkSession, grams(phrases, templates))
    rows = written(hits(docs, table), "license-hits")  # ids and the few hits of each text
    voted = written(diagonals(rows, table), "license-votes")  # few rows, used twice below
    places = (
        voted.filter("base and votes = total")
        .groupBy("doc_id", "_th")
        .agg(
            F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"),
            F.collect_set("label").alias("base_labels"), F.array().cast("array<string>").alias("more"), F.lit(1.0).alias("score"),
        )
    )
    covered = (
        spans(voted.filter("not base"))
        .groupBy("doc_id", "_th")
        .agg(F.collect_set(F.when(F.col("covered") >= coverage, F.col("label"))).alias("more"), F.max("covered").alias("score"))
    )
    found = (
        places.unionByName(covered, allowMissingColumns=True)
        .groupBy("doc_id", "_th")
        .agg(
            F.max("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
            F.flatten(F.collect_list("base_labels")).alias("base_labels"), F.flatten(F.collect_list("more")).alias("more"), F.max("score").alias("score"),
        )
        .alias("f")
    )
    none = F.array().cast("array<string>")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.alias("d").join(found, F.expr("d._th = f._th and d.doc_id <=> f.doc_id"), "left").select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        names(F.coalesce("base_labels", none)).alias("base_labels"),
        names(F.concat(F.coalesce("base_labels", none), F.coalesce("more", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
