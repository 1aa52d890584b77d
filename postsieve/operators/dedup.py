"""First sighting of each listing, within a batch and against the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.functions.keys import ID_DIGITS, listing_digest
from postsieve.operators.sizes import in_place

ARRIVAL = ("src_rank", "endpoint_ord", "src_pos")

# Decides between rows of one place, as when an endpoint was landed twice in a batch.
CONTENT = ("source", "title", "company", "url", "location", "description")

# A batch whose keys take at most this many bytes as a hash table (KEY_BYTES each, by the
# digest's fixed width) is broadcast to the store instead of shuffling the store to it.
# The driver holds that table in several forms at once, hence well below its memory.
BROADCAST_MAX_KEY_BYTES = 16 << 20
KEY_BYTES = 128


def with_key(df: DataFrame) -> DataFrame:
    """Add ``job_key``, which tells listings apart, and ``job_id``, its printed prefix."""
    return df.withColumn("job_key", listing_digest()).withColumn("job_id", F.left("job_key", F.lit(ID_DIGITS)))


def first_wins(df: DataFrame, key: Sequence[str] = ("job_key",), order: Sequence[str] = ARRIVAL) -> DataFrame:
    """One row per key: the earliest in ``order``.

    A rank-one window filter is limited before the shuffle, so each map task sends
    at most one row per key and a key that holds most rows stays small.
    """
    window = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def new_only(
    batch: DataFrame,
    store: DataFrame,
    batch_rows: int | None = None,
    key: str = "job_key",
    keys: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``batch`` whose key the store does not hold.

    ``batch_rows`` is a known bound on the batch. When it is small the store is cut to
    the batch's keys where it lies, and only the hits move. ``keys`` may name a cheaper
    table with the same keys as the batch.
    """
    known = store.select(key)
    if batch_rows is not None and KEY_BYTES * batch_rows <= BROADCAST_MAX_KEY_BYTES:
        keys = (batch if keys is None else keys).select(key).distinct()
        return batch.join(known.join(F.broadcast(keys), key, "left_semi").distinct(), key, "left_anti")
    return batch.join(in_place(known), key, "left_anti")


def without_packed(batch: DataFrame, packed: Sequence[DataFrame], key: str = "job_key") -> DataFrame:
    """The rows of ``batch`` whose key is in none of ``packed``, tables bucketed by key: the
    batch is brought to their buckets, they are read where they lie."""
    for known in packed:
        batch = batch.join(in_place(known), key, "left_anti")
    return batch
