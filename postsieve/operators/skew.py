"""Joins with a table of unique keys where some keys may hold much of the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than this part of the rows, so fewer keys than this
# are heavy, whatever the size of the tables.
HEAVY = 5_000


def look_up(rows: DataFrame, table: DataFrame, key: Sequence[str], weight: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; ``how`` is inner or left.

    ``key`` is unique and not null in ``table``, whose column ``weight`` tells how many of
    ``rows`` bear it. Heavy keys, of which there are fewer than ``heavy``, are broadcast, so
    that their rows stay where they lie; no key of the other, shuffled join holds more than
    1/``heavy`` of the rows. Rows whose key is null match nothing. Both inputs are read more
    than once and should be tables.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * F.lit(heavy) > F.lit(total)
    hot, cold = table.filter(is_heavy).drop(weight), table.filter(~is_heavy).drop(weight)
    if hot.isEmpty():
        return rows.join(cold, list(key), how)
    near = rows.join(F.broadcast(hot), list(key), "inner")
    rest = rows.join(F.broadcast(hot.select(*key)), list(key), "left_anti")
    return near.unionByName(rest.join(cold, list(key), how))
