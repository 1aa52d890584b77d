"""License scan by diagonal voting.

All rolling word k-gram hashes of all texts join the positions at which license templates
have them. A match votes for the diagonal (position in the text minus position in the
template); neighbouring diagonals, which one inserted or lost word sets apart, merge; a
merged span counts when enough of the template stands there in a span of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.llm.common import byte_pieces, mix
from postsieve.llm.words import ALNUM, grams, split_words

K = 2
MAX_TEMPLATE_GRAMS = 100_000  # the broadcast side; more templates than that are refused

# The base phrases and their labels, in the order given.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening sentences of well-known license notices and their labels.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
]

HEADER = np.int64(-(2**63))  # stands before the grams of each text, and matches one row


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """(gram, template, place, length, label, base) for each gram of each template."""
    rows = [(int(HEADER), -1, 0, 0, None, False)]
    for i, (text, label) in enumerate([*phrases, *notices]):
        hashes = split_words([text.encode()], ALNUM).hashes
        if len(hashes) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(int(g), i, j, len(hashes), label, i < len(phrases)) for j, g in enumerate(grams(hashes, k).view(np.int64))]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError("too many templates to broadcast")
    return spark.createDataFrame(rows, "gram long, template int, place int, length int, label string, base boolean")


def gram_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, text_hash, n_words, grams): a text's rolling grams behind HEADER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part, texts in byte_pieces(batch.column(1), 1_000_000):
                words = split_words(texts, ALNUM)
                counts = np.diff(words.bounds)
                every = grams(words.hashes, k).view(np.int64)
                lists, sums = [], []
                for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                    lists += [[HEADER], every[a : max(a, b - k + 1)]]
                    sums.append(mix(words.hashes[a:b] + np.arange(b - a, dtype=np.uint64)).sum(dtype=np.uint64))
                lengths = [1 + max(0, n - k + 1) for n in counts]
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, len(texts)),
                        pa.array(np.array(sums, dtype=np.uint64).view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))),
                    ],
                    names=["doc_id", "text_hash", "n_words", "grams"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, text_hash long, n_words long, grams array<long>")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, drift: int = 2, min_share: float = 0.7) -> DataFrame:
    """Verified spans and a header per text: (doc_id, text_hash, copies, n_words, spans).

    Merged diagonals count the places of the template that stand in the text, each once
    however many diagonals hold it. Where merged diagonals reach too far to be one copy, the
    best of them is judged alone.

    ``spans``: array of (template, label, base, start, end, share), in words from 0, end
    exclusive. Base phrases need every word; notices ``min_share`` of their grams within
    one and a half times their length. ``known`` is the broadcast side, of bounded size.
    One row per (doc_id, word sequence): ``copies`` counts rows that repeat both.
    Null texts count as empty and get a row without spans; an empty table gives none.
    """
    found = gram_rows(docs, id_col, text_col, k).select("doc_id", "text_hash", "n_words", F.posexplode("grams").alias("at", "gram"))
    hits = found.join(F.broadcast(known), "gram")
    diagonal = F.when(F.col("template") < 0, 0).otherwise(F.col("at") - 1 - F.col("place"))
    # one row per text and diagonal; a header row counts how often the text occurs
    longest = known.agg(F.max("length")).first()[0] or 0
    slots = [f"places{i}" for i in range(max(1, -(-longest // 64)))]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    held = [F.bit_or(F.when(F.floor(F.col("place") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(slots)]
    votes = hits.groupBy("doc_id", "text_hash", "template", diagonal.alias("diagonal")).agg(
        F.count("*").alias("votes"),
        *held,
        F.min(F.col("at") - 1).alias("lo"),
        F.max(F.col("at") - 1).alias("hi"),
        F.first("n_words").alias("n_words"),
        F.first("length").alias("length"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
    )
    one = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(one) > drift) | F.col("base")
    merged = (
        votes.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(one))
        .groupBy("doc_id", "text_hash", "template", "group")
        .agg(
            F.sum("votes").alias("votes"),
            F.max(F.struct("votes", "lo", "hi")).alias("best"),
            *[F.bit_or(c).alias(c) for c in slots],
            F.min("lo").alias("start"),
            (F.max("hi") + k).alias("end"),
            F.first("n_words").alias("n_words"),
            F.first("length").alias("length"),
            F.first("label").alias("label"),
            F.first("base").alias("base"),
        )
    )
    texts = W.partitionBy("doc_id", "text_hash")
    judged = merged.withColumn("copies", F.max(F.when(F.col("template") < 0, F.col("votes"))).over(texts))
    whole = F.col("length") - k + 1
    together = sum((F.bit_count(c) for c in slots), F.lit(0)) / whole
    alone = F.col("best.votes") / F.col("copies") / whole
    near = (together >= min_share) & (F.col("end") - F.col("start") <= 1.5 * F.col("length"))
    merged_span = F.struct("template", "label", "base", "start", "end", together.alias("share"))
    best_span = F.struct("template", "label", "base", F.col("best.lo").alias("start"), (F.col("best.hi") + k).alias("end"), alone.alias("share"))
    span = (
        F.when(F.col("template") < 0, None)
        .when(F.col("base"), F.when(alone == 1, best_span))
        .when(near, merged_span)
        .when(alone >= min_share, best_span)
    )
    return judged.groupBy("doc_id", "text_hash").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )


def report(scanned: DataFrame) -> DataFrame:
    """One row per document: counts, places and labels of its spans, and a score."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    rows = scanned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
