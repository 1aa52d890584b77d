"""Line dedup over a whole corpus, in DataFrame functions only.

Lines are reduced to hashes with the place they stand at, range-partitioned by hash and
document, and sorted by document and position inside a partition. One pass over that order
marks the first occurrence of a line in each document; counts of these tell which lines
repeat. What returns to a document is a run-length compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.llm.common import cut
from postsieve.operators.skew import look_up

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SECOND = 1  # goes before the line in the second word of its hash

BROADCAST_MAX_BYTES = 32 << 20


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, version, pos, h1, h2) of every line whose key has at least ``min_chars`` code
    points. A key is the line stripped of ``SPACE`` and with A-Z lower-cased; h1 and h2 are
    two 64-bit hashes of it, 128 bits in all. ``version`` tells rows of one id apart."""
    text = _text(text_col)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(text).alias("version"),
        F.posexplode(_lines(F.translate(text, UPPER, LOWER))).alias("pos", "line"),
    )
    keyed = rows.select("id", "version", "pos", F.btrim("line", F.lit(SPACE)).alias("key"))
    long = keyed.filter(F.length("key") >= min_chars)
    return long.select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SECOND), "key").alias("h2"))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(id, version, dropped): for each document that loses lines, their sorted positions.

    A key found in at least ``min_docs`` documents loses its lines everywhere but in the
    document with the largest id that holds it, where all of them stay. A line that fills a
    third of the corpus is spread over many partitions, as the documents are part of the
    range; its count is combined per partition, and the decision reaches its rows by a
    broadcast of the few keys that are so frequent.

    Null texts are one empty line. Rows that repeat an id are one document when documents are
    counted, and null ids are one document, smaller than any other; each row still gets the
    positions of its own text.
    """
    by_line = ["h1", "h2"]
    places = line_places(docs, id_col, text_col, min_chars).repartitionByRange("h1", "h2", "id")
    nth = F.row_number().over(W.partitionBy(*by_line, "id").orderBy("pos"))
    places = cut(places.withColumn("first", nth == 1))
    counted = places.groupBy(*by_line).agg(
        F.count_if("first").alias("docs"), F.max("id").alias("last"), F.count("*").alias("rows")
    )
    repeated = cut(counted.filter(F.col("docs") >= min_docs).select(*by_line, "last", "rows"))
    gone = look_up(places.drop("first"), repeated, by_line, "rows").filter(~F.col("id").eqNullSafe(F.col("last")))
    return cut(gone.groupBy("id", "version").agg(F.array_sort(F.collect_set("pos")).alias("dropped")))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The kept lines as runs (start, length), in order: the gaps between dropped positions."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(dropped)),
        lambda i: F.struct(
            F.coalesce(F.get(dropped, i - 1) + 1, F.lit(0)).alias("start"),
            F.coalesce(F.get(dropped, i), n_lines).alias("end"),
        ),
    )
    runs = F.filter(gaps, lambda g: g["end"] > g["start"])
    return F.transform(runs, lambda g: F.struct(g["start"].alias("start"), (g["end"] - g["start"]).alias("length")))


def with_keep_runs(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, n_lines, n_dropped, keep_runs) per row of ``docs``; ``doc`` holds all its
    columns, whatever their names. Bitmaps are broadcast when they measure few bytes."""
    text = _text(text_col)
    rows = docs.select(
        F.struct("*").alias("doc"),
        text.alias("text"),
        F.col(f"`{id_col}`").alias("row_id"),
        F.xxhash64(text).alias("row_version"),
        F.size(_lines(text)).alias("n_lines"),
    )
    size = bitmaps.agg(F.sum(F.size("dropped") * 8 + 128)).first()[0] or 0
    marks = F.broadcast(bitmaps) if size <= BROADCAST_MAX_BYTES else bitmaps
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_version") == F.col("version"))
    joined = rows.join(marks, same, "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return joined.select(
        "doc",
        "text",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        keep_runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs"),
    )


def kept_text(text: Column, n_dropped: Column, runs: Column) -> Column:
    """The lines of ``text`` in ``runs``, joined by line feeds."""
    bound = F.transform(F.array(F.struct(_lines(text).alias("lines"), runs.alias("runs"))), _cut_out)
    return F.when(n_dropped == 0, text).otherwise(F.array_join(F.get(bound, F.lit(0)), "\n"))


def _cut_out(b: Column) -> Column:
    return F.flatten(F.transform(b["runs"], lambda r: F.slice(b["lines"], r["start"] + 1, r["length"])))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_lines, n_dropped, keep_runs, kept_sha256).

    Texts are read once more to be digested; only bitmaps are joined to them. Nulls, repeats
    and ties are told in ``keep_bitmaps``; other columns are not read; an empty table gives
    an empty result.
    """
    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = with_keep_runs(narrow, keep_bitmaps(narrow, id_col, text_col), id_col, text_col)
    kept = kept_text(F.col("text"), F.col("n_dropped"), F.col("keep_runs"))
    return rows.select(
        F.col("doc")[id_col].alias(id_col), "n_lines", "n_dropped", "keep_runs", F.sha2(kept, 256).alias("kept_sha256")
    )
