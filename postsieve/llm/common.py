"""What several operators share: scratch tables, byte-level words, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.store.folders import shared_folder

# Odd constants of two rounds of multiply-and-shift mixing of 64-bit values.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

WORD_BASE = np.uint64(0x9E3779B97F4A7C15)


_SHIPPED: set[str] = set()


# Rows per Arrow batch, where the session has Spark's default of 10,000: texts are long.
BATCH_ROWS = 2_000
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and keep
    their batches small.

    The driver serves the archive; executors need no shared folder for it.
    """
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "postsieve.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage there.

    Lost executors later re-read the files; nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a partition's batches, that gives freed memory back before its
    task begins and when it ends: workers stay for later stages, and would keep it meanwhile."""

    def wrapped(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Return what Arrow and the C library hold of freed memory, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all 64 bits (a bijection)."""
    v = values.copy()
    v ^= v >> np.uint64(30)
    v *= MIX_1
    v ^= v >> np.uint64(27)
    v *= MIX_2
    v ^= v >> np.uint64(31)
    return v


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def _inverse(base: int) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class RollingBytes:
    """Hashes of any substring of a byte array from one pass of prefix sums.

    hash(i, j) depends on the bytes i..j-1 alone: prefix sums of byte * base**position,
    shifted back by base**-i, then mixed together with the length.
    """

    def __init__(self, data: np.ndarray, base: np.uint64 = WORD_BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])
        self.back = powers(_inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * MIX_2)

    def all(self, width: int) -> np.ndarray:
        """Hashes of every window of ``width`` bytes."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b"" if t is None else t.encode("utf-8") for t in texts]


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs of a boolean array."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(lengths: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices whose lengths sum to about ``limit``, so that work on a batch
    of long texts stays bounded; one longer text is a slice of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield slice(start, len(lengths))


def byte_pieces(column: pa.Array, limit: int) -> Iterator[tuple[slice, list[bytes]]]:
    """The texts of an Arrow string column as UTF-8, null as empty, in pieces of about
    ``limit`` bytes; only one piece at a time is copied out of the batch."""
    raw = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False)
    for part in pieces(sizes, limit):
        yield part, [b or b"" for b in raw.slice(part.start, part.stop - part.start).to_pylist()]


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition as a star per local component (child, parent < child)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    children = [x for x in parent if parent[x] != x]
    for i in range(0, len(children), 50_000):
        some = children[i : i + 50_000]
        yield pd.DataFrame({"child": some, "parent": [root(x) for x in some]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (child, parent), where parent is the
    smallest id of the component, for every id but that one.

    Each partition first contracts its edges to stars. Rounds of star operations then
    join the stars: every node's neighbours move to the smallest one. Minima are
    pre-aggregated, and written before the join, so that a hub's rows can be split.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    star = cut(pairs.mapInPandas(_forest, "child long, parent long").distinct())
    while not _is_star(star):
        both = star.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(star.select("parent", "child"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        large = cut(large)
        least = cut(large.groupBy("child").agg(F.min("parent").alias("m")))
        joined = large.join(least, "child")
        small = joined.select("child", F.col("m").alias("parent")).union(
            joined.filter("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        )
        star = cut(small.distinct())
    return star


def _is_star(star: DataFrame) -> bool:
    """No node has two parents, and no parent has a parent."""
    twice = star.groupBy("child").count().filter("count > 1").limit(1)
    if not twice.isEmpty():
        return False
    chained = star.select(F.col("parent").alias("child")).distinct().join(star, "child", "left_semi").limit(1)
    return chained.isEmpty()
