"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Words of a k-gram.
K = 3
#: Phrases whose words must stand consecutively, and their labels.
BASE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Public license notices, and their labels.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]
#: A diagonal joins the one before it if it lies within so many words of it.
NEIGHBOURS = 3
#: Share of a notice's words that verified k-grams must cover, and most words of a span for each word of the notice.
COVERED, STRETCH = 0.8, 1.3


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: letters, digits and all beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def gram_hashes(w: Column) -> Column:
    """The rolling hash of the K words from each place on; the last places give hashes of fewer words."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]))


def templates(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, t_words, t_pos, hash, gram), a few hundred rows that the lists above fix."""
    rows = [(i, label, base, text) for i, (label, base, text) in enumerate([(l, True, t) for l, t in BASE_PHRASES] + [(l, False, t) for l, t in notices])]
    values = ", ".join(f"({i}, '{label}', {str(base).lower()}, '{text}')" for i, label, base, text in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, base, text)").withColumn("w", words(F.col("text")))
    df = df.select("template", "label", "base", F.size("w").alias("t_words"), "w", F.posexplode(gram_hashes(F.col("w"))).alias("t_pos", "hash"))
    return df.where(F.col("t_pos") <= F.col("t_words") - K).select("template", "label", "base", "t_words", "t_pos", "hash", F.concat_ws(" ", F.slice("w", F.col("t_pos") + 1, K)).alias("gram"))


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All K-grams of words whose hash is in a notice or phrase are joined by it to their places there; equal hashes of other
    words are sorted out. Matches vote for the diagonal of their places; a base phrase stands where a diagonal has all
    its K-grams. For notices, neighbouring diagonals merge into spans, and a span counts if its K-grams cover 80 % of
    the notice's words and it is at most 1.3 times as long. score is the largest such share, 1 with a base phrase.
    first_word and last_word are null without base phrases, labels are empty strings without any. Null and empty texts
    have no words. Repeated rows give repeated results, a null doc_id is kept; an empty table gives no rows, and other
    columns are ignored. The broadcast side is made of the lists in this module or `notices` alone.
    """
    spark = docs.sparkSession
    known = templates(spark, NOTICES if notices is None else notices)
    hashes = [r.hash for r in known.select("hash").distinct().collect()]  # a few hundred, that the lists fix
    w = docs.select("doc_id", F.xxhash64("text").alias("tag"), words(F.col("text")).alias("w"))
    places = F.filter(F.transform(gram_hashes(F.col("w")), lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))), lambda g: g["hash"].isin(hashes))
    grams = F.transform(places, lambda g: F.struct(g["pos"].alias("pos"), g["hash"].alias("hash"), F.concat_ws(" ", F.slice("w", g["pos"] + 1, K)).alias("own")))
    base = written(w.select("doc_id", "tag", F.size("w").cast("long").alias("n_words"), grams.alias("grams")))  # texts are read once
    hits = base.select("doc_id", "tag", F.explode("grams").alias("g")).select("doc_id", "tag", "g.*").join(F.broadcast(known), "hash").where(F.col("own") == F.col("gram"))
    key = ["doc_id", "tag", "template", "label", "base", "t_words"]
    votes = written(hits.select(*key, (F.col("pos") - F.col("t_pos")).alias("diagonal"), "pos", "t_pos").distinct().groupBy(*key, "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list("t_pos").alias("at")))

    places = votes.where(F.col("base") & (F.size("at") == F.col("t_words") - K + 1)).groupBy("doc_id", "tag").agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_labels"))

    order = Window.partitionBy("doc_id", "tag", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS).cast("int")
    spans = votes.where(~F.col("base")).withColumn("new", F.coalesce(apart, F.lit(1))).withColumn("span", F.sum("new").over(order)).groupBy(*key, "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + K - 1))))) / F.col("t_words")
    spans = spans.withColumn("covered", covered).where((F.col("covered") >= COVERED) & (F.col("last") + K - F.col("first") <= STRETCH * F.col("t_words")))
    spans = spans.groupBy("doc_id", "tag").agg(F.collect_set("label").alias("labels"), F.max("covered").alias("covered"))

    found = places.select("doc_id", "tag", "n_base", "first_word", "last_word", "base_labels", F.lit(None).cast("array<string>").alias("labels"), F.lit(1.0).alias("score"))
    found = found.unionByName(spans.select("doc_id", "tag", F.lit(0).alias("n_base"), F.lit(None).cast("int").alias("first_word"), F.lit(None).cast("int").alias("last_word"), F.lit(None).cast("array<string>").alias("base_labels"), "labels", F.col("covered").alias("score")))
    none = F.array().cast("array<string>")
    found = found.groupBy("doc_id", "tag").agg(F.sum("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max(F.coalesce("base_labels", none)).alias("base_labels"), F.max(F.coalesce("labels", none)).alias("labels"), F.max("score").alias("score"))
    out = base.select("doc_id", "tag", "n_words").alias("d").join(found.alias("f").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.tag") == F.col("f.tag")), "left")
    joined = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in c]))), ",")
    return out.select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined("base_labels").alias("base_labels"),
        joined("base_labels", "labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
