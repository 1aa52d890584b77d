"""Size checks before something is broadcast or turned into constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 32 << 20

# A hashed row takes about this many times its plain text, plus a fixed part per row.
_OVERHEAD, _ROW = 4, 64


def hashed_width(df: DataFrame) -> Column:
    """Estimated bytes of a row of ``df`` in a broadcast hash table."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType == T.StringType()]
    return F.lit(_OVERHEAD) * sum(texts, F.lit(_ROW + 8 * len(df.columns)))


def hashed_bytes(df: DataFrame) -> int:
    """Estimated size of ``df`` as a broadcast hash table, from one aggregate over it."""
    return df.agg(F.sum(hashed_width(df))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when it is known to fit; otherwise as it is, and the
    join is shuffled."""
    return F.broadcast(df) if hashed_bytes(df) <= max_bytes else df


def in_place(df: DataFrame) -> DataFrame:
    """``df`` with the hint that it is not broadcast to a join.

    The optimizer takes the compressed size of files, shared out over their columns, for the
    size of a table: by that millions of digests are a small table, which the driver would hold.
    """
    return df.hint("merge")


def at_most(df: DataFrame, rows: int) -> list | None:
    """All rows of ``df`` when there are at most ``rows``, else None."""
    head = df.limit(rows + 1).collect()
    return head if len(head) <= rows else None
