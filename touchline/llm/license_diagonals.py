"""License scan by diagonal voting.

Words of texts and of licence templates are hashed in rolling runs of `K`. All runs of all texts are joined to template
places; a hit votes for its diagonal, text place minus template place. Votes are counted by text, template and
diagonal; diagonals at most `DRIFT` apart are merged (words put in or left out move the rest of a span to the next
diagonal); a merged span is verified by the share of template words its hits cover and by its length. A template that
passes gives its label. Base phrases are counted beside it and give their labels as they are.

The template table is a parameter of fixed size (checked before it is sent to all tasks). Votes are counted in tasks before they are
shuffled. A text is named by id and content hash; repeated rows each get their row. Null or empty text has no words and
no label. The score is the largest coverage of a passed template, 1 if there is a base phrase, else 0. Hashes have 64 bits; that two
runs fall together is taken as impossible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import ascii_lower
from touchline.llm.native import let, neighbours

K = 3
DRIFT = 2
COVERAGE = 0.7
STRETCH = 1.6          # longest span against the template
TEMPLATE_WORDS = 200_000  # most template words that are sent to all tasks

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and notice text.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _runs(column: str) -> Column:
    """Hash of each run of K words, in place order."""
    pairs = lambda h: neighbours(h, F.size(h), lambda a, b: F.xxhash64(a, b))
    return let(F.transform(F.col(column), lambda w: F.xxhash64(w)), lambda h: let(pairs(h), pairs))


def template_places(spark, templates=TEMPLATES) -> DataFrame:
    """(run, template, label, place, length) of all templates of K words and more."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    cut = rows.withColumn("words", words(F.col("text")))
    return cut.select("template", "label", F.size("words").alias("length"), F.posexplode(_runs("words")).alias("place", "run"))


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified spans: text_key, template, label, coverage, first_place, last_place (words, last included)."""
    places = template_places(docs.sparkSession, templates)
    if sum(len(t.split()) for _, t in templates) <= TEMPLATE_WORDS:
        places = F.broadcast(places)
    cut = docs.select(_key().alias("text_key"), words(F.col("text")).alias("words"))
    runs = cut.select("text_key", F.posexplode(_runs("words")).alias("at", "run"))
    votes = (runs.join(places, "run").withColumn("diagonal", F.col("at") - F.col("place"))
             .groupBy("text_key", "template", "label", "length", "diagonal")
             .agg(F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high")))
    order = Window.partitionBy("text_key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    bands = votes.withColumn("new", F.when(gap <= DRIFT, 0).otherwise(1)).withColumn("band", F.sum("new").over(order))
    merged = bands.groupBy("text_key", "template", "label", "length", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("first_place"), (F.max("high") + K - 1).alias("last_place"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    return (merged.withColumn("coverage", covered / F.col("length"))
            .where((F.col("coverage") >= COVERAGE) & (F.col("last_place") - F.col("first_place") + 1 <= F.col("length") * STRETCH))
            .select("text_key", "template", "label", "coverage", "first_place", "last_place"))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def phrase_places(column: str, phrase: str) -> Column:
    """Places where the words of a phrase stand in a row."""
    parts = phrase.split()
    whole = F.concat(F.lit(" "), F.array_join(column, " "), F.lit(" "))
    starts = F.filter(F.transform(F.col(column), lambda w, i: F.when((w == parts[0]) & F.coalesce(F.array_join(F.slice(F.col(column), i + 1, len(parts)), " ") == phrase, F.lit(False)), i)), lambda i: i.isNotNull())
    return F.when(F.contains(whole, F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<int>"))


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """The contract's columns."""
    cut = docs.select("doc_id", _key().alias("text_key"), words(F.col("text")).alias("words"))
    base = cut.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), *[phrase_places("words", p).alias(f"base_{i}") for i, (p, _) in enumerate(BASE)])
    found = F.concat(*[f"base_{i}" for i in range(len(BASE))])
    own = F.array_compact(F.array(*[F.when(F.size(f"base_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    told = base.select("doc_id", "text_key", "n_words", F.size(found).cast("long").alias("n_base"), F.array_min(found).cast("long").alias("first_word"),
                       F.array_max(found).cast("long").alias("last_word"), own.alias("own"))
    more = spans(docs, templates).groupBy(F.col("text_key").alias("k")).agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    joined = told.join(more, F.col("text_key") == F.col("k"), "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("own"), ",").alias("base_labels"),
                         F.array_join(labels, ",").alias("labels"),
                         F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))
