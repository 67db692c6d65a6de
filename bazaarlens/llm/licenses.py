"""License scan by diagonal voting.

Every rolling word 3-gram of a document is joined with the positions of the templates' 3-grams; a
hit votes for the diagonal (document position - template position). A diagonal that holds all of a
phrase's grams is a place of the phrase. For longer notices, votes of one template are put in text
order and neighbouring diagonals (a few words put in or left out) merge; a merged span is verified
by the share of the template's words that it covers, compared as words, not as hashes.

Null and empty texts have no words and score 0. Each row gives one row, repeated or not. Other
columns are not read. The templates are a fixed table of a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.llm.grams import gram_bits, gram_places, text_grams
from bazaarlens.llm.shared import keyed
from bazaarlens.session import durable

GRAM = 3
#: Words between two votes of one span, and how far their diagonals may lie apart.
MAX_GAP = 12
MAX_DRIFT = 6
MIN_SHARE = 0.7

# Phrases whose exact places count, and notices with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
     "and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
     "the free software foundation", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]


def templates(spark) -> DataFrame:
    """(id, text, label, phrase) of the fixed table."""
    rows = [(f"p{i}", text, label, True) for i, (text, label) in enumerate(PHRASES)] + [(f"n{i}", text, label, False) for i, (text, label) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "id string, text string, label string, phrase boolean")


def license_spans(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (key, doc_id, n_words), and (key, id, label, phrase, first, last, share): verified spans."""
    grams = durable(text_grams(known.select("id", "text"), GRAM).join(known.select("id", "label", "phrase"), "id"), "templates")
    places = durable(gram_places(docs, [GRAM], gram_bits(grams)), "grams")
    positions = grams.select("id", "label", "phrase", F.col("n_words").alias("length"), F.col("pos").alias("at"), "hash", "gram")
    votes = (
        places.filter("pos >= 0").select("key", "pos", "hash", "context").join(positions, "hash").filter(F.col("context") == F.col("gram"))
        .select("key", "id", "label", "phrase", "length", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    )
    exact = (
        votes.filter("phrase").groupBy("key", "id", "label", "phrase", "length", "diagonal").agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("length") - GRAM + 1)
        .select("key", "id", "label", "phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length")).alias("last"), F.lit(1.0).alias("share"))
    )
    # Votes of a diagonal that stand close are one segment; segments in text order merge across near diagonals.
    along = W.partitionBy("key", "id", "diagonal").orderBy("pos")
    parted = votes.filter("not phrase").withColumn("cut", (F.col("pos") - F.lag("pos").over(along) > MAX_GAP).cast("int"))
    parted = parted.withColumn("segment", F.sum(F.coalesce("cut", F.lit(0))).over(along))
    segments = parted.groupBy("key", "id", "label", "length", "diagonal", "segment").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    order = W.partitionBy("key", "id").orderBy("first", "diagonal")
    apart = (F.col("first") - F.lag("last").over(order) > MAX_GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > MAX_DRIFT) | (
        F.col("low") <= F.lag("high").over(order) - GRAM)
    merged = segments.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("span", F.sum("apart").over(order))
    # A segment of n votes covers n + 2 words of the template when unbroken; that is also its least cover when broken.
    spans = merged.groupBy("key", "id", "label", "length", "span").agg(
        F.min("first").alias("first"), (F.max("last") + GRAM).alias("last"), F.sum(F.col("n") + GRAM - 1).alias("covered"))
    share = F.least(F.lit(1.0), F.col("covered") / F.col("length"))
    found = spans.withColumn("share", share).filter(F.col("share") >= MIN_SHARE).select("key", "id", "label", F.lit(False).alias("phrase"), "first", "last", "share")
    return places.filter("pos < 0").select("key", "doc_id", "n_words"), exact.unionByName(found)


def license_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    rows, _ = keyed(docs)
    every, spans = license_spans(rows, templates(docs.sparkSession))
    base = F.col("phrase")
    by_doc = spans.groupBy(F.col("key").alias("other")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    none = F.lit("")
    return every.join(by_doc, F.col("key") == F.col("other"), "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
