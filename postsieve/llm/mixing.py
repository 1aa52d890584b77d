"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (weights sum to 1) gets its j-th block (from 0) released at slot
floor(j / w) and due by slot ceil((j + 1) / w). One block runs per slot, the released one
with the earliest deadline. Every prefix of the schedule then holds, of each source, less
than one block more or less than its weight says, however long it grows: windows follow
from the weights themselves, as integers in the proportion of the given floats. The
driver deals the blocks, one step each, and writes them as a table that the rows join.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.llm.common import cut

BLOCK_ROWS = 16
PERIOD = 2048  # slots of a period, for weights as integer shares
THIN = 8  # once sources with rows left weigh less than 1 / THIN, the others' slots close
DEALT = 1 << 20  # blocks that the driver holds at a time
BROADCAST_BLOCKS = 100_000
NEW = ["mix_slot", "mix_place", "mix_balanced"]
BINS = 1024  # parts in which the rows of one source are numbered


def shares_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Integer shares of a period, at least 1 each, by largest remainders; ties by name."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError("a period needs a slot for every source")
    total, free = sum(weights.values()), period - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    shares = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive")
    ratios = {s: w.as_integer_ratio() for s, w in weights.items()}
    scale = math.lcm(*{d for _, d in ratios.values()})
    parts = {s: n * (scale // d) for s, (n, d) in ratios.items()}
    common = math.gcd(*parts.values())
    return {s: n // common for s, n in parts.items()}


def deal(parts: dict[str, int], rows: dict[str, int], block_rows: int = 1) -> Iterator[tuple[str, int, int, bool]]:
    """(source, block, slot, balanced) of every block of ``rows`` (a number for each
    source) in the order of slots; balanced until a slot finds no full block.

    Slots of a source that has run out stay empty while sources with blocks left weigh
    1 / THIN or more; later they close, which leaves every other block in its window. So
    the steps follow the number of blocks, whatever the weights are.
    """
    total = sum(parts.values())
    blocks = {s: -(-rows.get(s, 0) // block_rows) for s in parts}
    full = {s: rows.get(s, 0) // block_rows for s in parts}
    weight = sum(n for s, n in parts.items() if blocks[s])
    active = sum(1 for s in parts if blocks[s])
    waiting = [(0, s, 0) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot, balanced = 0, True
    while active:
        closed = not balanced and weight * THIN < total
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            if not closed or j < blocks[s]:
                heapq.heappush(ready, (-(-(j + 1) * total // parts[s]), s, j))
        if not ready:
            slot = max(slot, waiting[0][0])
            continue
        due, s, j = heapq.heappop(ready)
        if closed and j >= blocks[s]:
            continue
        if due <= slot:
            raise AssertionError("a deadline was missed")
        balanced = balanced and j < full[s]
        if j < blocks[s]:
            yield s, j, slot, balanced
            if j + 1 == blocks[s]:
                active -= 1
                weight -= parts[s]
        heapq.heappush(waiting, ((j + 1) * total // parts[s], s, j + 1))
        slot += 1


def schedule(shares: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot of one period: earliest deadline first."""
    return [(s, j) for s, j, _, _ in deal(shares, shares)]


def dealt_blocks(spark: SparkSession, parts: dict[str, int], rows: dict[str, int], block_rows: int) -> tuple[DataFrame, int]:
    """The blocks as a table (_s, _block, mix_slot, mix_balanced), and how many there are."""
    kinds = [("_s", pa.string()), ("_block", pa.int64()), ("mix_slot", pa.int64()), ("mix_balanced", pa.bool_())]
    written, n = [], 0
    for some in batched(deal(parts, rows, block_rows), DEALT):
        columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*some, strict=True), kinds, strict=True)]
        written.append(cut(spark.createDataFrame(pa.table(columns, names=[name for name, _ in kinds]))))
        n += len(some)
    empty = spark.createDataFrame([], "_s string, _block long, mix_slot long, mix_balanced boolean")
    return reduce(DataFrame.union, written) if written else empty, n


def proportional(docs: DataFrame, source_col: str = "source", power: float = 1.0) -> dict[str, float]:
    """Weights of the sources as their row counts to ``power`` (below 1 lifts small
    ones). One number per source goes to the driver; any number of sources will do."""
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("s")).count().collect()
    return {r["s"]: float(r["count"]) ** power for r in counts}


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
    bins: int = BINS,
) -> DataFrame:
    """``docs`` plus mix_slot (the slot of the row's block), mix_place (from 0, inside the
    block) and mix_balanced; ordering by (mix_slot, mix_place) gives the mixture.

    Within a source the order is by a hash of the id, then the id; blocks hold
    ``block_rows`` rows, the last one of a source fewer. All rows stay. mix_balanced is
    true as long as no source has run out, where each prefix of whole blocks deviates by
    less than one block from the weights. Later slots of exhausted sources stay empty or
    close; every block remains in the window that its source's weight gives it. With
    ``period`` the weights count as their integer shares of so many slots.

    A null source counts as the source of empty name. A source without weight raises an
    error when the result is computed; a weighted source without rows only leaves its
    slots empty (mix_balanced then is false from its first one on). Rows that repeat an id get
    places of their own, in no particular order. Columns named as the new ones are
    replaced. Numbering is by bins of each source (counts first, then places inside a
    bin), so a source with most rows spreads over ``bins`` groups.
    """
    parts = exact(weights) if period is None else shares_of(weights, period)
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("mix"), id_col)
    # the caller's columns travel in one, whatever their names; the bin follows the hash's
    # order, so bins in turn are the source in turn
    own = [F.col(f"`{c}`") for c in docs.columns if c not in NEW]
    rows = docs.select(F.struct(*own).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_s"), order.alias("_h"))
    rows = rows.withColumn("_bin", F.floor((F.col("_h") / 2.0**64 + 0.5) * bins).cast("int"))
    sizes = rows.groupBy("_s", "_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = cut(sizes.withColumn("_before", before))  # at most ``bins`` rows a source
    counts = {r["_s"]: r["n"] for r in sizes.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    blocks, n = dealt_blocks(spark, parts, counts, block_rows)
    place = F.row_number().over(W.partitionBy("_s", "_bin").orderBy("_h", "_id")) - 1
    numbered = rows.withColumn("_at", place).join(F.broadcast(sizes) if len(counts) * bins <= 1_000_000 else sizes, ["_s", "_bin"])
    at = F.col("_before") + F.col("_at")
    numbered = numbered.withColumns({"_block": F.floor(at / block_rows), "mix_place": (at % block_rows).cast("int")})
    numbered = numbered.join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, ["_s", "_block"], "left")
    missing = F.raise_error(F.concat(F.lit("no weight for source "), "_s")).cast("long")
    numbered = numbered.withColumn("mix_slot", F.coalesce("mix_slot", missing))
    return numbered.select("_row.*", *NEW)


def in_mixed_order(spark: SparkSession, mixed: DataFrame) -> DataFrame:
    """The mixture's rows laid out in its order: ranges of slots, sorted inside."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place")
