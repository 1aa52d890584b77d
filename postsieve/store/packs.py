"""Packs: old batches of a store, merged so that files and folders stay few.

Every batch writes partitions of its own. A pack holds many batches of a table in one
folder; the folder ``done`` names the packs that are complete for all tables, and a pack
whose range of numbers lies inside another's has been merged into it. A batch that still has
a partition of its own counts as it is there, so neither a crash between packing and
clean-up nor a replay of an old batch shows a row twice.

With the tables a pack keeps what later runs ask of history: the known keys, bucketed by
digest so that a batch can be compared without moving them, and the listings that nothing
has delivered yet, by falling score.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.store.folders import children, mark, qualified, remove

COMPRESSION = "zstd"  # of tables, most of which is text
MAX_PACKS = 8  # more are merged into one

# Keys of a pack lie in buckets of about this many rows, and in no fewer than a shuffle has
# partitions, so that the batch is brought to them and not the other way round.
BUCKET_KEYS = 2_000_000

# Listings below it are never alerts by a template's threshold; asking for them reads all.
LEAST_SCORE = 1

KEYS = "job_key string, batch_id string"


class Packs:
    """The packs under ``root``. Tables are given as name → (schema, partition column)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = qualified(spark, f"{root}/packs")

    def names(self) -> list[str]:
        """Complete packs in order of age, those merged into another left out."""
        ranges = [(name, *map(int, name.split("-"))) for name in children(self.spark, f"{self.root}/done")]
        inside = lambda a, b: a != b and b[1] <= a[1] and a[2] <= b[2]
        return [r[0] for r in sorted(ranges, key=lambda r: r[1]) if not any(inside(r, other) for other in ranges)]

    def path(self, what: str, name: str) -> str:
        return f"{self.root}/{what}/{name}"

    def read(self, table: str, schema: T.StructType, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.path(table, n) for n in names])

    def known_keys(self, names: list[str]) -> list[DataFrame]:
        """One bucketed table (job_key, batch_id) per pack."""
        return [self._bucketed(n) for n in names]

    def undelivered(self, schema: T.StructType, names: list[str]) -> DataFrame:
        """The packed listings of LEAST_SCORE or more that no packed delivery has taken."""
        return self.spark.read.schema(schema).parquet(self.path("pending", names[-1]))

    def _table(self, name: str) -> str:
        return "postsieve_keys_" + hashlib.md5(self.path("keys", name).encode()).hexdigest()

    def _bucketed(self, name: str) -> DataFrame:
        """The keys of a pack with their bucketing, which the session's catalog has to know."""
        table, (folder,) = self._table(name), [c for c in children(self.spark, self.path("keys", name)) if not c.startswith("_")]
        if not self.spark.catalog.tableExists(table):
            count, at = folder.removeprefix("buckets-"), self.path("keys", name) + "/" + folder
            self.spark.sql(
                f"CREATE TABLE {table} ({KEYS}) USING parquet CLUSTERED BY (job_key) SORTED BY (job_key) INTO {count} BUCKETS LOCATION '{at}'"
            )
        return self.spark.table(table)

    def write(self, lo: int, hi: int, merged: list[str], tables: dict[str, DataFrame], snapshot: DataFrame) -> str:
        """Write all parts of a pack, then name it complete."""
        name = f"{lo:06d}-{hi:06d}"
        for what in (*tables, "keys", "pending"):
            remove(self.spark, self.path(what, name))
        for table, rows in tables.items():
            rows.hint("rebalance").write.option("compression", COMPRESSION).parquet(self.path(table, name))
        jobs = self.spark.read.parquet(self.path("jobs", name))
        keys = jobs.select("job_key", "batch_id")
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(partitions, -(-jobs.count() // BUCKET_KEYS))
        table = self._table(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (
            keys.repartition(buckets, "job_key").write.mode("overwrite").bucketBy(buckets, "job_key").sortBy("job_key")
            .option("path", f"{self.path('keys', name)}/buckets-{buckets}").saveAsTable(table)
        )
        by_score = snapshot.repartitionByRange(F.col("score").desc(), "job_key").sortWithinPartitions(F.col("score").desc(), "job_key")
        by_score.write.option("compression", COMPRESSION).parquet(self.path("pending", name))
        mark(self.spark, f"{self.root}/done/{name}")
        for old in merged:
            remove(self.spark, f"{self.root}/done/{old}")
        return name

    def clean(self, tables) -> None:
        """Remove packs that have been merged, and snapshots but the newest."""
        names = self.names()
        for what in (*tables, "keys"):
            for old in set(children(self.spark, f"{self.root}/{what}")) - set(names):
                if what == "keys":
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
                remove(self.spark, self.path(what, old))
        for old in set(children(self.spark, f"{self.root}/pending")) - set(names[-1:]):
            remove(self.spark, self.path("pending", old))


def part_ids(spark: SparkSession, path: str) -> list[str]:
    """Ids of the partitions that lie apart under a table's path."""
    return [unquote(c.split("=", 1)[1]) for c in children(spark, path) if "=" in c]
