"""Counters and error messages of a run."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.sources.explode import NOT_FOUND


def source_counts(listings: DataFrame) -> DataFrame:
    """Listings per endpoint, per source kind and in total (level 2, 1, 0)."""
    return (
        listings.rollup("source_kind", "endpoint_ord")
        .agg(F.count(F.lit(1)).alias("listings"), F.grouping_id().alias("_g"))
        .select(
            "source_kind",
            "endpoint_ord",
            F.when(F.col("_g") == 0, 2).when(F.col("_g") == 1, 1).otherwise(0).alias("level"),
            "listings",
        )
    )


def error_messages(quarantine: DataFrame) -> DataFrame:
    """One message per source kind and reason, with its count, in a fixed order.

    There are at most (kinds × reasons) messages, however many rows went wrong; each
    row stays in the quarantine table. Endpoints that are simply gone are no error.
    """
    return (
        quarantine.filter(F.col("reason") != F.lit(NOT_FOUND))
        .groupBy(F.when(F.col("reason") == "unsupported_kind", F.lit("roster")).otherwise(F.col("source_kind")).alias("source_kind"), "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "source_kind",
            "reason",
            "n",
            F.format_string("%s failed: %s (%d)", "source_kind", "reason", "n").alias("message"),
        )
    )


def error_list(messages: DataFrame) -> DataFrame:
    """One row: the messages of ``error_messages`` as one ordered array."""
    entry = F.struct("source_kind", "reason", "message")
    return messages.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["message"]).alias("errors"))
