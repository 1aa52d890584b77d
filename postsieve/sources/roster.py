"""The roster of company boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.dedup import first_wins
from postsieve.operators.sizes import BROADCAST_MAX_BYTES, hashed_bytes, in_place
from postsieve.schemas import QUARANTINE, ROSTER, local_frame
from postsieve.sources.explode import UNSUPPORTED


def roster_frame(spark: SparkSession, entries: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Roster table from (name, ats, token) entries in their own order."""
    return local_frame(spark, [(i, *e) for i, e in enumerate(entries)], ROSTER)


def first_endpoints(roster: DataFrame) -> DataFrame:
    """The first roster entry of each (ats, token)."""
    return first_wins(roster, key=("ats", "token"), order=("ord",))


def fits_broadcast(roster: DataFrame) -> bool:
    return hashed_bytes(roster) <= BROADCAST_MAX_BYTES


def with_company(payloads: DataFrame, roster: DataFrame, small: bool | None = None) -> DataFrame:
    """Board payloads of rostered endpoints, with the roster's company name and order.

    Bodies are wide, so a roster known to be ``small`` is broadcast to them; by default
    its size is looked up.
    """
    small = fits_broadcast(roster) if small is None else small
    endpoints = first_endpoints(roster).select(
        F.col("ats").alias("source_kind"), "token", F.col("name").alias("_name"), F.col("ord").alias("_ord")
    )
    return (
        payloads.join(F.broadcast(endpoints) if small else endpoints, ["source_kind", "token"])
        .withColumn("company", F.col("_name"))
        .withColumn("endpoint_ord", F.col("_ord"))
        .drop("_name", "_ord")
    )


def unsupported(roster: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Quarantine rows for roster endpoints no source can read."""
    return (
        first_endpoints(roster)
        .filter(~F.coalesce(F.col("ats").isin(*kinds), F.lit(False)))
        .select(
            F.col("ats").alias("source_kind"),
            "token",
            F.lit(None).cast("string").alias("endpoint"),
            F.col("ord").alias("endpoint_ord"),
            F.lit(UNSUPPORTED).alias("reason"),
            F.col("name").alias("detail"),
            F.lit(None).cast("string").alias("raw"),
        )
        .select(*QUARANTINE.fieldNames())
    )


def zero_yield(roster: DataFrame, listings: DataFrame) -> DataFrame:
    """Roster endpoints without listings, labelled 'name (ats/token)'."""
    yielding = listings.select(F.col("source_kind").alias("ats"), "token").distinct()
    return (
        first_endpoints(roster)
        .join(in_place(yielding), ["ats", "token"], "left_anti")
        .select("ord", "name", "ats", "token", F.format_string("%s (%s/%s)", "name", "ats", "token").alias("label"))
    )
