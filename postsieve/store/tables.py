"""Store tables: plain parquet, append-only, one partition per batch or run.

A batch or run owns its partition and rewrites it as a whole, so a replay leaves the
store as it was. Nothing is ever updated: what was delivered is a ledger of its own.
``pack`` merges old batches, see ``packs``.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve import schemas
from postsieve.functions.text import truncate
from postsieve.operators.sizes import in_place
from postsieve.store.folders import ensure_checkpoint_dir, remove
from postsieve.store.packs import COMPRESSION, LEAST_SCORE, MAX_PACKS, Packs, part_ids

DESCRIPTION_CHARS = 2000  # fixed value

# Table → (schema, partition column).
TABLES = {
    "staged": (schemas.STAGED, "batch_id"),
    "jobs": (schemas.JOBS, "batch_id"),
    "scored": (schemas.SCORED, "batch_id"),
    "quarantine": (schemas.QUARANTINE, "batch_id"),
    "deliveries": (schemas.DELIVERIES, "run_id"),
    "runs": (schemas.RUNS, "run_id"),
    "outbox": (schemas.OUTBOX, "run_id"),
    "summaries": (schemas.SUMMARIES, "run_id"),
    "clocks": (schemas.CLOCKS, "run_id"),
    "steps": (schemas.STEPS, "run_id"),
    "source_counts": (schemas.SOURCE_COUNTS, "run_id"),
    "zero_yield": (schemas.ZERO_YIELD, "run_id"),
}

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class ListingStore:
    """Tables under one root path on shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.packs = Packs(spark, self.root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def part_path(self, table: str, part: str) -> str:
        return f"{self.path(table)}/{TABLES[table][1]}={quote(part, safe='')}"

    def read(self, table: str) -> DataFrame:
        """The table, or an empty one of the same schema when it does not exist yet."""
        live, names = self._load(self.path(table), schemas.partitioned(*TABLES[table])), self.packs.names()
        return live.unionByName(self._packed(table, names)) if names and table != "staged" else live

    def _packed(self, table: str, names: list[str]) -> DataFrame:
        """Packed rows of the batches that have no partition of their own."""
        rows = self.packs.read(table, schemas.partitioned(*TABLES[table]), names)
        apart = part_ids(self.spark, self.path(table))
        return rows.filter(~F.col(TABLES[table][1]).isin(apart)) if apart else rows

    def _load(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], schema)

    def bootstrap(self) -> None:
        """Create the tables that are missing; safe to repeat."""
        for table, (_, by) in TABLES.items():
            empty = self.spark.createDataFrame([], schemas.partitioned(*TABLES[table]))
            empty.write.mode("ignore").partitionBy(by).parquet(self.path(table))

    def replace(self, table: str, part: str, rows: DataFrame) -> DataFrame:
        """Write one partition of a table, replacing it if it exists; return it as stored.

        The partition's own path is overwritten, so that no rows leave it empty.
        """
        schema, _ = TABLES[table]
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        shaped.write.mode("overwrite").option("compression", COMPRESSION).parquet(self.part_path(table, part))
        return self.part(table, part)

    def part(self, table: str, part: str) -> DataFrame:
        """One partition, read by its path: other partitions are not even listed."""
        schema, by = TABLES[table]
        try:
            return self.spark.read.schema(schema).parquet(self.part_path(table, part))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
        names = self.packs.names()
        if not names or table == "staged":
            return self.spark.createDataFrame([], schema)
        return self.packs.read(table, schemas.partitioned(schema, by), names).filter(F.col(by) == part).drop(by)

    def clock(self, run_id: str, now: datetime) -> datetime:
        """The time at which the run first began: ``now``, unless it began before."""
        known = self.part("clocks", run_id).select(F.unix_micros("started_at").alias("t")).first()
        if known is None:
            self.replace("clocks", run_id, self.spark.range(1).select(F.lit(now).alias("started_at")))
            return now
        return _EPOCH + timedelta(microseconds=known["t"])

    def jobs_before(self, batch_id: str) -> DataFrame:
        """Stored listings of all other batches."""
        return self.read("jobs").filter(F.col("batch_id") != F.lit(batch_id))

    def keys_before(self, batch_id: str) -> tuple[DataFrame, list[DataFrame]]:
        """Keys of all other batches: those that lie apart, and per pack a table bucketed by
        key, which a join reads where it lies."""
        live = self._load(self.path("jobs"), schemas.partitioned(*TABLES["jobs"])).select("job_key", "batch_id")
        names = self.packs.names()
        hidden = sorted({batch_id, *part_ids(self.spark, self.path("jobs"))}) if names else []
        packed = [k.filter(~F.col("batch_id").isin(hidden)) for k in self.packs.known_keys(names)]
        return live.filter(F.col("batch_id") != F.lit(batch_id)).select("job_key"), [k.select("job_key") for k in packed]

    def queue(self, min_score: int) -> tuple[DataFrame, DataFrame]:
        """(listings, deliveries) from which the queue follows: a listing of at least
        ``min_score`` is pending when it is in the first and not in the second.

        The packs keep what was undelivered when they were made; only that and the batches
        that lie apart are read. A batch that has been packed and lies apart again, as a
        replay leaves it, or a threshold below the packs' own takes all of history.
        """
        names = self.packs.names()
        if names and min_score >= LEAST_SCORE:
            apart = sorted({i for t in ("jobs", "deliveries") for i in part_ids(self.spark, self.path(t))})
            clocks = self.packs.read("clocks", schemas.partitioned(*TABLES["clocks"]), names)
            if not apart or clocks.filter(F.col("run_id").isin(apart)).isEmpty():
                schema = schemas.partitioned(*TABLES["jobs"])
                live = self._load(self.path("jobs"), schema)
                ledger = self._load(self.path("deliveries"), schemas.partitioned(*TABLES["deliveries"]))
                return live.unionByName(self.packs.undelivered(schema, names)), ledger
        return self.read("jobs"), self.read("deliveries")

    def pack(self, keep: int, at: int = 0) -> int:
        """Merge all but the ``keep`` newest complete batches into a pack; their staged rows,
        which only their own runs read, are removed. Nothing happens while at most ``at``
        complete batches lie apart. Returns the number of batches packed.

        Safe to repeat after a failure at any point: batches count as packed once the pack is
        named complete, and only then do their partitions go.
        """
        names = self.packs.names()
        done = set(part_ids(self.spark, self.path("runs")))
        if len(done) <= max(keep, at):
            return 0
        clocks = self._load(self.path("clocks"), schemas.partitioned(*TABLES["clocks"]))
        ordered = [r.run_id for r in clocks.orderBy("started_at", "run_id").collect() if r.run_id in done]
        old = ordered[: len(ordered) - keep]
        if not old:
            return 0
        # batches that are in a pack already, after a replay or a failure, take their packs along
        packed_before = names and not self.packs.read("clocks", schemas.partitioned(*TABLES["clocks"]), names).filter(F.col("run_id").isin(old)).isEmpty()
        merged = names if packed_before or len(names) >= MAX_PACKS else []
        tables, apart = {}, {}
        for table, (schema, by) in TABLES.items():
            if table != "staged":
                apart[table] = self._load(self.path(table), schemas.partitioned(schema, by)).filter(F.col(by).isin(old))
                tables[table] = apart[table].unionByName(self._packed(table, merged)) if merged else apart[table]
        waiting = apart["jobs"].filter(F.col("score") >= LEAST_SCORE)
        if names:
            earlier = self.packs.undelivered(schemas.partitioned(*TABLES["jobs"]), names)
            waiting = waiting.unionByName(earlier.filter(~F.col("batch_id").isin(part_ids(self.spark, self.path("jobs")))))
        delivered = tables["deliveries"] if packed_before else apart["deliveries"]
        snapshot = waiting.join(in_place(delivered.select("job_key")), "job_key", "left_anti").select(*apart["jobs"].columns)
        last = int(names[-1].split("-")[1]) if names else 0
        lo = int(merged[0].split("-")[0]) if merged else last + 1
        self.packs.write(lo, last + 1, merged, tables, snapshot)
        for table in TABLES:
            for part in old:
                remove(self.spark, self.part_path(table, part))
        self.packs.clean(tables)
        return len(old)

    def append_jobs(self, scored: DataFrame, batch_id: str, seen_at, description_chars: int | None = DESCRIPTION_CHARS) -> DataFrame:
        """Store new listings; the description is cut only here, after scoring, and not at
        all where ``description_chars`` is None."""
        kept = scored.withColumn("seen_at", F.lit(seen_at))
        if description_chars is not None:
            kept = kept.withColumn("description", truncate("description", description_chars))
        return self.replace("jobs", batch_id, kept)

    def mark_delivered(self, results: DataFrame, run_id: str, at, mark: str = "ok") -> DataFrame:
        """Add delivery results (job_key, job_id, ok) to the run's ledger.

        With mark='ok' only successes leave the queue; 'attempted' takes every listing
        that was tried out of it. Entries of an earlier attempt of the run stay.
        """
        if mark not in ("ok", "attempted"):
            raise ValueError(f"mark must be 'ok' or 'attempted', not {mark!r}")
        taken = results.filter("ok") if mark == "ok" else results
        ensure_checkpoint_dir(self.spark)
        before = self.part("deliveries", run_id).checkpoint()  # its files are about to be replaced
        columns = ["job_key", "job_id", "delivered_at", "ok"]
        added = taken.withColumn("delivered_at", F.lit(at)).select(*columns)
        return self.replace("deliveries", run_id, before.select(*columns).unionByName(added))

    def append_run(self, run: DataFrame, run_id: str) -> DataFrame:
        """Append the audit record of a run."""
        return self.replace("runs", run_id, run)
