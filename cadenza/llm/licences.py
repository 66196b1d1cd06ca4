"""License scans by diagonal voting: word k-grams of all texts joined to the positions of template texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Passages of public licence texts and notices, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
)
K = 3
# The characters that end a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenceScan:
    """``neighbour``: how far apart diagonals may lie to be one; ``min_share``: part of a template's k-grams that a span
    must hold; templates of fewer than ``short`` k-grams must be whole."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    neighbour: int = 3
    min_share: float = 0.7
    short: int = 10


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, GAP), lambda w: w != "")


def _grams(words: Column) -> Column:
    """The word k-grams of an array column, in order; none if there are fewer than K words."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(K)]))
    return F.when(n >= K, grams).otherwise(F.array().cast("array<string>"))


def template_positions(spark: SparkSession, config: LicenceScan) -> DataFrame:
    """(template, label, exact, n_grams, at, gram): phrases first, then passages. Its size is that of the fixed texts."""
    rows = []
    texts = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in config.templates]
    for t, (label, text, exact) in enumerate(texts):
        w = text.split(" ")
        rows += [(t, label, exact, len(w) - K + 1, at, " ".join(w[at : at + K])) for at in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, n_grams int, at int, gram string").withColumn("hash", F.xxhash64("gram"))


def licence_hits(docs: DataFrame, config: LicenceScan = LicenceScan()) -> DataFrame:
    """One row per verified span: doc_id, text_id, template, label, exact, first_word, last_word, share (of the template's k-grams).

    Every k-gram of every text is joined by hash (and, against collisions, by its words) to the template positions,
    a broadcast table of fixed size. Hits are aggregated by diagonal (place in the text less place in the template);
    neighbouring diagonals merge; a span stands if it holds enough different k-grams of its template: all of a phrase
    on one diagonal, ``min_share`` of a passage.
    """
    spark = docs.sparkSession
    table = F.broadcast(template_positions(spark, config))
    df = docs.select("doc_id", F.xxhash64("text").alias("text_id"), _words(F.col("text")).alias("words"))
    df = df.select("doc_id", "text_id", F.posexplode(_grams(F.col("words"))).alias("pos", "gram"))
    hits = df.withColumn("hash", F.xxhash64("gram")).join(table, ["hash", "gram"])
    keys = ["doc_id", "text_id", "template"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*keys, "diagonal").agg(
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n_grams").alias("n_grams"),
        F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    along = Window.partitionBy(*keys).orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > config.neighbour, F.lit(True))
    spans = votes.withColumn("span", F.sum(apart.cast("int")).over(along)).groupBy(*keys, "span").agg(
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n_grams").alias("n_grams"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("low").alias("first_word"), (F.max("high") + K - 1).alias("last_word"),
    )
    share = F.size("ats") / F.col("n_grams")
    whole = F.col("exact") | (F.col("n_grams") < config.short)  # a short passage differs from its kin in one word
    return spans.withColumn("share", share).where(F.col("share") >= F.when(whole, 1.0).otherwise(config.min_share)).select(
        "doc_id", "text_id", "template", "label", "exact", "first_word", "last_word", "share"
    )


def licence_scan(docs: DataFrame, config: LicenceScan = LicenceScan()) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts places of phrases; first_word and last_word are the least and greatest start of one (null: none).
    labels has the labels of verified passages too; score is the greatest share of a template found (1 for a phrase).
    Null and empty texts have no words. Repeated rows repeat: results are joined by doc_id and text digest, so rows of
    one doc_id with different texts keep apart.
    """
    hits = licence_hits(docs, config)
    per = hits.groupBy("doc_id", "text_id").agg(
        F.sum(F.col("exact").cast("long")).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    ).withColumnsRenamed({"doc_id": "d", "text_id": "t"})
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    both = all_docs.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("t")), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
