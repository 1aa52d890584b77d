"""The alert queue: what is pending, and in which order it goes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.operators.sizes import in_place
from postsieve.store.folders import ensure_checkpoint_dir

ALERT_ORDER = ("score", "seen_at", "job_key")


def at_least(df: DataFrame, min_score: int) -> DataFrame:
    """Listings at or above a score; the filter reaches the parquet scan."""
    return df.filter(F.col("score") >= F.lit(min_score))


def pending(jobs: DataFrame, deliveries: DataFrame, min_score: int = 1, key: str = "job_key") -> DataFrame:
    """Stored listings at or above the score that no delivery has taken, from any run."""
    return at_least(jobs, min_score).join(in_place(deliveries.select(key)), key, "left_anti")


def number_rows(
    df: DataFrame, levels: Sequence[str] = ("score", "seen_at"), unique: str = "job_key", digits: int = 3
) -> DataFrame:
    """Add ``seq``, the 1-based position in the order (levels..., unique), without gaps.

    ``unique`` is a hexadecimal digest, hence spread evenly over its leading digits.
    Rows are numbered inside (levels, leading digits), and each such cell is
    shifted by the sizes of the cells before it. A level value that holds most rows
    is thus spread over 16**digits tasks; only counts are ordered level by level.
    The levels must not be null.

    ``df`` is evaluated once, into a checkpoint; give it narrow and join wide columns
    to the result. Counts have a checkpoint of their own, which every level reads.
    """
    cell = [*levels, "_cell"]
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("_cell", F.left(F.col(unique), F.lit(digits))).checkpoint()
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    within = W.partitionBy(*cell).orderBy(unique)
    return (
        rows.join(in_place(_rows_before(counts, cell)), cell)
        .withColumn("seq", F.row_number().over(within) + F.col("_before"))
        .select(*df.columns, "seq")
    )


def _rows_before(counts: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rows that lie before each cell: one running sum per level over that level's totals.

    The last window sees the distinct values of the first level only.
    """
    before = counts.select(*cell, F.lit(0).cast("bigint").alias("_before"))
    for depth in range(1, len(cell) + 1):
        prefix, column = list(cell[: depth - 1]), cell[depth - 1]
        totals = counts.groupBy(*prefix, column).agg(F.sum("_n").alias("_n"))
        window = W.partitionBy(*(prefix or [F.lit(0)])).orderBy(column)
        earlier = F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, -1))
        shift = totals.select(*prefix, column, F.coalesce(earlier, F.lit(0)).alias("_shift"))
        before = (
            before.join(shift, [*prefix, column])
            .withColumn("_before", F.col("_before") + F.col("_shift"))
            .drop("_shift")
        )
    return before
