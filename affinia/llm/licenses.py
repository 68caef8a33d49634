"""Licence scan: phrase counts, and diagonal voting against licence templates.

All rolling 4-grams of a document's words are looked up among the 4-grams of the
templates (a fixed table). The hits meet the template positions in a Spark join;
every hit votes for the diagonal document position - template position;
neighbouring diagonals are merged, so a few inserted or missing words do not
split a copy; a span counts if the template words covered by its hits reach
`THRESHOLD` of the template and at least half of the span's own words are hits.

Words are what separates at ASCII characters other than letters and digits, with
A-Z in lower case. Defined results: null and empty texts have no words, no
labels and score 0; repeated rows give a row each, with equal results; an empty
table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm.words import LOWER, NOT_ALNUM, pieces, utf8, words_of
from affinia.session import materialise

GRAM = 4
THRESHOLD = 0.8
MERGE = 3  # diagonals this close belong to one span

# Phrases of the contract with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as the licences' own texts give them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
]


def _words(texts: list[str]):
    data, borders = utf8(pa.array(texts, pa.string()))
    return words_of(LOWER[data], borders, NOT_ALNUM)


def template_grams(templates: list[tuple[str, str]], gram: int = GRAM) -> list[tuple[int, int, str, int, int]]:
    """(hash, template, label, position, words) of every rolling gram of the templates."""
    words = _words([text for _, text in templates])
    at, got = words.rolling(gram)
    size = np.diff(words.first)
    return [
        (int(h), int(t), templates[t][0], int(i - words.first[t]), int(size[t]))
        for i, h, t in zip(at, got.view(np.int64), words.doc[at])
    ]


def scan_words(
    docs: DataFrame, grams: list[int], phrases: dict[str, str], id_col: str, text_col: str, gram: int = GRAM
) -> DataFrame:
    """(_id, _row, n_words, n_base, first_word, last_word, base, hits): phrase places, and the grams that templates hold too."""
    known = np.unique(np.array(grams, np.int64).view(np.uint64))
    wanted = {}  # phrase length -> (hash, label)
    for phrase, label in phrases.items():
        words = _words([phrase])
        size = len(words.hash)
        wanted.setdefault(size, []).append((words.rolling(size)[1][0], label))
    hit_type = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            n = batch.num_rows
            data, borders = utf8(batch.column("_text"))
            words = words_of(LOWER[data], borders, NOT_ALNUM)
            count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set] = [set() for _ in range(n)]
            for size, listed in wanted.items():
                at, got = words.rolling(size)
                for value, label in listed:
                    place = at[got == value]
                    doc = words.doc[place]
                    place = place - words.first[doc]
                    np.add.at(count, doc, 1)
                    np.minimum.at(low, doc, place)
                    np.maximum.at(high, doc, place)
                    for d in np.unique(doc):
                        labels[d].add(label)
            at, got = words.rolling(gram)
            near = np.minimum(np.searchsorted(known, got), max(len(known) - 1, 0))
            hit = known[near] == got if len(known) else np.zeros(len(got), bool)
            at, got = at[hit], got[hit].view(np.int64)
            doc = words.doc[at]
            cuts = np.searchsorted(doc, np.arange(n + 1))
            flat = pa.StructArray.from_arrays([pa.array(at - words.first[doc], pa.int64()), pa.array(got, pa.int64())], ["pos", "gram"])
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_row"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(low, pa.int64(), mask=none),
                    pa.array(high, pa.int64(), mask=none),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat).cast(hit_type),
                ],
                ["_id", "_row", "n_words", "n_base", "first_word", "last_word", "base", "hits"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    ddl = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
        "hits array<struct<pos: bigint, gram: bigint>>"
    )
    schema = T.StructType([rows.schema["_id"], rows.schema["_row"], *T.StructType.fromDDL(ddl).fields])
    return rows.mapInArrow(scan, schema)


def spans(scanned: DataFrame, grams: DataFrame, gram: int = GRAM, merge: int = MERGE, threshold: float = THRESHOLD) -> DataFrame:
    """(_id, _row, template, label, first, last, coverage) of every verified span."""
    hits = (
        scanned.where(F.size("hits") > 0).select("_id", "_row", "hits").distinct()
        .select("_id", "_row", F.explode("hits").alias("hit"))
        .select("_id", "_row", F.col("hit.pos").alias("pos"), F.col("hit.gram").alias("gram"))
    )
    voted = (
        hits.join(F.broadcast(grams), "gram")  # the template table is a constant
        .withColumn("diagonal", F.col("pos") - F.col("place"))
        .groupBy("_id", "_row", "template", "label", "words", "diagonal")
        .agg(
            F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("votes"),
            F.collect_set("place").alias("places"),  # at most the template's words
        )
    )
    along = W.partitionBy("_id", "_row", "template").orderBy("diagonal")
    grouped = voted.withColumn(
        "fresh", (F.col("diagonal") - F.lag("diagonal").over(along) > merge).cast("int")
    ).withColumn("span", F.sum(F.coalesce("fresh", F.lit(1))).over(along))
    merged = grouped.groupBy("_id", "_row", "template", "label", "words", "span").agg(
        F.min("first").alias("first"), (F.max("last") + gram - 1).alias("last"), F.sum("votes").alias("votes"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.lit(gram - 1)))))
    ) / F.col("words")
    dense = F.col("votes") + gram - 1 >= (F.col("last") - F.col("first") + 1) / 2
    return merged.withColumn("coverage", covered).where((F.col("coverage") >= threshold) & dense).select(
        "_id", "_row", "template", "label", "first", "last", "coverage"
    )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    `score` is 1 where a phrase stands, else the best coverage of a verified span.
    """
    spark = docs.sparkSession
    listed = template_grams(templates)
    grams = spark.createDataFrame(listed, "gram bigint, template int, label string, place bigint, words bigint")
    scanned = materialise(scan_words(docs, [x[0] for x in listed], phrases, id_col, text_col), "licences")
    best = (
        spans(scanned, grams)
        .groupBy(F.col("_id").alias("_sid"), F.col("_row").alias("_srow"))
        .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    )
    same = F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_row") == F.col("_srow"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.drop("hits").join(best, same, "left").select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
