"""License scan by diagonal voting.

All rolling word 2-grams of all documents are hashed and joined with the positions of
the templates' 2-grams (a fixed list of a few hundred rows, hence broadcast).  A match
votes for its diagonal, document position minus template position.  A phrase of m
words stands at a place exactly if all its m-1 positions vote for one diagonal: the
base phrases.  License texts tolerate edits: neighbouring diagonals (inserted or lost
words) merge into one span, which is verified by the share of the template's positions
it covers and by its length.  A hash match counts only if the 2-gram's words, carried
beside its hash, are equal too.

Votes are summed per (document, template, diagonal) with map-side aggregation; a
document's diagonals are bounded by its length, so a hot source or a common license
line cannot gather in one task.

The score is 1 with a base label, else the best share of a template that a span covers,
verified or not.

Defined results: null text is empty, has no words, no labels and score 0; a very long text
is read whole, and its matches are rows of their own; equal labels of several spans are
named once; repeated rows get equal results; null ids are kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, staged, table
from .wordhash import WordIds, alnum_words, grams, texts

# fixed values: base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: openings of well-known license texts and the usual one-line notices
LICENSES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "gpl-3.0": ("licensed under the gnu general public license version 3",),
    "gpl-any": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("licensed under cc by sa 4 0",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
GRAM = 2
#: Diagonals this close, or within a ``REACH``-th of the template, belong to one span; share of
#: positions that verifies a span.
DRIFT, REACH, COVER, STRETCH = 2, 4, 0.75, 1.5

_SCAN = "doc_id long, rid long, n_words long, grams array<struct<h: bigint, w: string>>"


def _templates() -> list[tuple[int, str, bool, list[bytes]]]:
    rows = [(phrase, label, True) for phrase, label in BASE.items()]
    rows += [(text, label, False) for label, texts_ in LICENSES.items() for text in texts_]
    return [(k, label, base, alnum_words(text.encode())) for k, (text, label, base) in enumerate(rows)]


def _positions(spark: SparkSession) -> DataFrame:
    """template, label, base, m (its 2-grams), at, th (hash), tw (words); one row (template -1)
    for the mark that every document carries."""
    ids, rows = WordIds(), [(-1, "", True, 1, 0, 0, "")]
    for k, label, base, words in _templates():
        hashes = grams(ids.array(words), GRAM).view(np.int64)
        rows += [(k, label, base, len(hashes), at, int(h), b" ".join(words[at : at + GRAM]).decode()) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, m int, at int, th long, tw string")


def rolling_grams(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n_words and all rolling 2-gram hashes, after one mark (hash 0) per
    document.  Words accompany the hashes that some template has."""
    ids = WordIds()
    known = np.unique(np.concatenate([grams(ids.array(w), GRAM) for _, _, _, w in _templates()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            n_words, sizes, hashes, lens, found = [], [], [], [], []
            for text in texts(batch.column(2)):
                words = alnum_words(text)
                g = grams(ids.array(words), GRAM)
                n_words.append(len(words))
                sizes.append(len(g) + 1)
                hashes += [np.zeros(1, np.uint64), g]
                length = np.zeros(len(g) + 1, np.int32)
                where = np.searchsorted(known, g)
                where[where == len(known)] = 0
                for p in np.flatnonzero(known[where] == g).tolist():
                    held = b" ".join(words[p : p + GRAM])
                    found.append(held)
                    length[p + 1] = len(held)
                lens.append(length)
            h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32) if lens else np.zeros(1, np.int32)
            w = pa.StringArray.from_buffers(len(h), pa.py_buffer(offsets), pa.py_buffer(b"".join(found)))
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), w], names=["h", "w"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(starts), values)],
                names=["doc_id", "rid", "n_words", "grams"],
            )

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("rid"), docs["text"].cast("string").alias("text"))
    return source.mapInArrow(run, _SCAN)


def votes(docs: DataFrame) -> DataFrame:
    """All matches of document and template positions, and every document's mark."""
    spread = rolling_grams(docs).select("doc_id", "rid", "n_words", F.posexplode("grams").alias("pos", "g"))
    spread = spread.select("doc_id", "rid", "n_words", (F.col("pos") - 1).alias("pos"), F.col("g.h").alias("h"), F.col("g.w").alias("w"))
    places = F.broadcast(_positions(docs.sparkSession))  # a fixed list
    return spread.join(places, (F.col("h") == F.col("th")) & (F.col("w") == F.col("tw"))).drop("h", "w", "th", "tw")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    met = staged(votes(docs), "license-votes")
    base_rows = met.where("template < 0").select("doc_id", "rid", "n_words")
    key = ["doc_id", "rid", "template", "label", "base", "m"]
    diagonals = (
        met.where("template >= 0")
        .groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    exact = diagonals.where("base AND size(ats) = m").groupBy("doc_id", "rid").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"),
    )
    by = Window.partitionBy("doc_id", "rid", "template").orderBy("diagonal")
    spans = (
        diagonals.where("NOT base")
        .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > F.greatest(F.lit(DRIFT), F.floor(F.col("m") / REACH))).cast("int"))
        .withColumn("span", F.sum(F.coalesce("new", F.lit(1))).over(by))
        .groupBy(*key, "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("cover", F.size("ats") / F.col("m"))
        .withColumn("verified", F.expr(f"cover >= {COVER} AND last - first + 1 <= {STRETCH} * m"))
        .where("size(ats) > 1")
        .groupBy("doc_id", "rid")
        .agg(
            F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("own_set"),
            F.max("cover").alias("cover"),
            F.collect_list(F.when(F.col("verified"), F.struct("label", "first", (F.col("last") + 1).alias("last"), "cover"))).alias("spans"),
        )
    )
    none = F.array().cast("array<string>")
    joined = base_rows
    for side, name in ((exact, "e"), (spans, "s")):
        side = side.withColumnsRenamed({"doc_id": f"{name}_id", "rid": f"{name}_rid"})
        joined = joined.join(side, base_rows["doc_id"].eqNullSafe(side[f"{name}_id"]) & (base_rows["rid"] == side[f"{name}_rid"]), "left")
    base_set = F.coalesce("base_set", none)
    return joined.select(
        base_rows["doc_id"], base_rows["rid"], "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.sort_array(base_set), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_set, F.coalesce("own_set", none))), ",").alias("labels"),
        F.when(F.size(base_set) > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).cast("double").alias("score"),
        "spans",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("rid", "spans")
