"""Target companies: membership and score floor."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.operators.sizes import at_most, broadcast_if_small


# Up to this many distinct names become a constant set; more are joined.
SCAN_MAX_NAMES = 1_000


def _lowered(names: DataFrame) -> DataFrame:
    return names.select(F.lower("name").alias("_target")).filter("_target is not null").distinct()


def mark_targets(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``is_target``: the company equals some ``names.name`` ignoring case.

    A few names become a constant set, and the listings stay where they are. Many are
    joined; names are distinct, so a skewed company can be split at run time.
    """
    targets = _lowered(names)
    company = F.lower(F.coalesce(F.col("company"), F.lit("")))
    few = at_most(targets, SCAN_MAX_NAMES)
    if few is not None:
        return df.withColumn("is_target", company.isin([r[0] for r in few]) if few else F.lit(False))
    flagged = broadcast_if_small(targets).withColumn("is_target", F.lit(True))
    return (
        df.join(flagged, company == F.col("_target"), "left")
        .drop("_target")
        .withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    )


def only_targets(df: DataFrame, names: DataFrame) -> DataFrame:
    """The listings of target companies."""
    return mark_targets(df, names).filter("is_target").drop("is_target")


def apply_target_floor(df: DataFrame, names: DataFrame) -> DataFrame:
    """Lift score 0 of target companies to 1 and replace the keywords by a mark.

    Blocked titles are lifted as well; their ``blocked`` flag stays.
    """
    lifted = F.col("is_target") & (F.col("score") == 0)
    mark = F.array(F.concat(F.lit("["), F.col("company"), F.lit(" target]")))
    marked = mark_targets(df, names)
    return marked.withColumns(
        {
            "keywords": F.when(lifted, mark).otherwise(F.col("keywords")),
            "score": F.when(lifted, F.lit(1)).otherwise(F.col("score")),
        }
    )
