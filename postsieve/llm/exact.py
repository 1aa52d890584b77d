"""Exact dedup by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import cut

SALTS = 16


def keep_last_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; null counts as empty. Of equal texts the largest id
    stays. Local copies meet first (partial aggregation in each map task), then the
    copies of a salt (a salt is a share of the map tasks), then the salts' winners. Every
    stage groups by digest and whole text, so a colliding digest never joins two texts.
    ``digest`` may replace the key (a function of the text column).

    Nulls: a null id is smaller than any other; a group of null ids keeps one of them as
    keep_id null, and ``kept`` is false for them unless all are null. Rows that repeat
    with one id and one text all stay rows and count in group_size; all that hold the
    winning id are kept. Other columns, of whatever name, are not read. An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    keyed = rows.withColumn("_key", (digest or (lambda c: F.sha2(c, 256)))(F.col("_text")))
    salted = keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("_key", "_text", "_salt").agg(F.max("_id").alias("_last"), F.count("*").alias("_n"))
    final = winners.groupBy("_key", "_text").agg(F.max("_last").alias("keep_id"), F.sum("_n").alias("group_size"))
    groups = cut(final.select("_key", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256")))
    if groups.groupBy("_key").count().filter("count > 1").isEmpty():
        joined = keyed.select("_id", "_key").join(groups, "_key")
    else:  # some digest stands for two texts: those rows join on the text's own hash too
        joined = keyed.select("_id", "_key", F.sha2("_text", 256).alias("text_sha256")).join(groups, ["_key", "text_sha256"])
    kept = F.coalesce(F.col("_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row per text.

    Rows that repeat one id with different texts are told apart by the text; a repeated
    (id, text) row stays once.
    """
    judged = keep_last_copies(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("keep"), F.col("text_sha256").alias("sha"))
    judged = cut(judged.groupBy("keep", "sha").agg(F.count("*").alias("n")))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    kept = rows.join(judged, F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("sha")), "left_semi")
    if not judged.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "digest"])
    return kept.select("row.*")
