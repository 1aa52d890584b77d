"""Streams over a landing folder of payload files.

A listing is new once, for ever. That is a question to the store, not to stream state,
so each micro-batch runs the batch job under an id made of the query's id and its epoch; an
epoch that is run again after a failure rewrites its own partitions, at its first clock.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.dedup import with_key
from postsieve.operators.scoring import score_listings
from postsieve.operators.targets import apply_target_floor
from postsieve.plans.polling import Deliver, RunConfig, run_batch
from postsieve.schemas import RAW_PAYLOAD
from postsieve.sources.registry import normalise
from postsieve.store import ListingStore, shared_folder
from postsieve.store.folders import children, remove, size_of
from postsieve.store.packs import COMPRESSION

# Size of a landed file where landings are compacted, and of the parts of it (before
# compression) that tasks can read apart.
LANDED_FILE_BYTES = 128 << 20
LANDED_GROUP_BYTES = 16 << 20

# Parts that an epoch is dealt into, for each core of the cluster.
TASKS_PER_CORE = 2


def write_landing(payloads: DataFrame, path: str, compact: bool = False) -> None:
    """Land payloads partitioned by source kind, so that each normaliser reads its own.

    A stream pays for every file: its epochs take a number of them. With ``compact`` files
    follow the size of what is landed and not the number of tasks that made it; payloads are
    then written beside the landing first, and copied without a shuffle.
    """
    rows = payloads.select(*RAW_PAYLOAD.fieldNames())
    if not compact:
        rows.write.mode("append").option("compression", COMPRESSION).partitionBy("source_kind").parquet(path)
        return
    spark, scattered = payloads.sparkSession, f"{path.rstrip('/')}-scattered/{uuid.uuid4().hex}"
    try:
        write_landing(rows, scattered)
        for kind in children(spark, scattered):
            if "=" not in kind:
                continue
            files = -(-size_of(spark, f"{scattered}/{kind}") // LANDED_FILE_BYTES)
            # partitioned by its folder's own name, so that a kind is spelt as in any other landing
            writer = spark.read.schema(RAW_PAYLOAD).option("basePath", scattered).parquet(f"{scattered}/{kind}").coalesce(files).write
            writer.mode("append").option("compression", COMPRESSION).option("parquet.block.size", LANDED_GROUP_BYTES).partitionBy("source_kind").parquet(path)
    finally:
        remove(spark, scattered)


def read_landing(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Stream of RAW_PAYLOAD rows from the files that arrive under ``path``."""
    reader = spark.readStream.format(file_format).schema(RAW_PAYLOAD)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(payloads: DataFrame, config: RunConfig, boards_only: bool = False) -> DataFrame:
    """Scored listings of a payload stream (or table), copies included; no state.

    On a stream the lexicon and the blocklist must be short enough to be expressions of a
    row; ``score_epochs`` takes any.
    """
    return _scored(_listings(payloads, config, boards_only), config)


def _listings(payloads: DataFrame, config: RunConfig, boards_only: bool) -> DataFrame:
    staged = normalise(payloads, config.roster, config.registry, boards_only=boards_only)
    return staged.filter(F.col("reason").isNull()).drop("reason", "detail", "raw")


def _scored(listings: DataFrame, config: RunConfig, key: str | None = None) -> DataFrame:
    scored = score_listings(with_key(listings), config.lexicon, config.blocklist, key=key)
    return apply_target_floor(scored, config.roster.select("name"))


def _each_epoch(
    payloads: DataFrame, store: ListingStore, name: str, checkpoint: str | None, interval: str | None,
    work: Callable[[DataFrame, str], None],
) -> StreamingQuery:
    """Start a query that hands each micro-batch, as a table, to ``work`` with its own id.

    The id is made of the query's id, which the checkpoint holds, and the epoch: another
    checkpoint never meets these batches, and an epoch that runs again has the id it had.
    The micro-batch is kept on the executors' disks while it is worked on, as every source
    reads its own part of it; what is lost there is read again from the landing. It is dealt by
    endpoint first: files are cut by their compressed size, by which one task may get all of a
    feed that compresses well, and write all its listings into one file again.
    """
    location = checkpoint or f"{shared_folder(store.spark)}/{name}"

    def each(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        tasks = TASKS_PER_CORE * batch.sparkSession.sparkContext.defaultParallelism
        held = batch.repartition(tasks, "source_kind", "token", "endpoint_ord", "endpoint").persist(StorageLevel.DISK_ONLY)
        try:
            work(held, f"{name}-{query}-{epoch:012d}")
        finally:
            held.unpersist()

    writer = payloads.writeStream.queryName(name).option("checkpointLocation", location).foreachBatch(each)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def score_epochs(
    payloads: DataFrame,
    store: ListingStore,
    config: RunConfig,
    name: str,
    checkpoint: str | None = None,
    boards_only: bool = False,
    interval: str | None = None,
) -> StreamingQuery:
    """Score a payload stream into the store's table ``scored``, one partition per epoch.

    Lexicons and blocklists of any length, in the form that batches use. An epoch that runs
    again replaces its partition, so each payload's listings are in the table once. A long
    lexicon reads the listings twice: they are parsed once and written before that, numbered,
    and removed when the epoch is scored.
    """
    config = config.resolved()

    def work(batch: DataFrame, batch_id: str) -> None:
        if config.lexicon.entries is not None:
            store.replace("scored", batch_id, score_stream(batch, config, boards_only))
            return
        spark, path = batch.sparkSession, f"{store.root}/listings/{uuid.uuid4().hex}"
        rows = _listings(batch, config, boards_only).withColumn("_row", F.monotonically_increasing_id())
        try:
            rows.write.option("compression", COMPRESSION).parquet(path)
            store.replace("scored", batch_id, _scored(spark.read.schema(rows.schema).parquet(path), config, key="_row"))
        finally:
            remove(spark, path)

    return _each_epoch(payloads, store, name, checkpoint, interval, work)


def poll(
    payloads: DataFrame,
    store: ListingStore,
    config: RunConfig,
    name: str,
    checkpoint: str | None = None,
    mode: str = "live",
    boards_only: bool = False,
    deliver: Deliver | None = None,
    interval: str | None = None,
    keep: int | None = None,
) -> StreamingQuery:
    """Start a polling query: all that has arrived, then stop; or every ``interval``.

    The stream's progress is kept in ``checkpoint``, by default under the session's
    shared folder, where ``name`` must stay the same from start to start. With ``keep``, the
    store is packed (``ListingStore.pack``) whenever twice as many batches lie apart.
    """
    config = config.resolved()

    def work(batch: DataFrame, batch_id: str) -> None:
        run_batch(store, batch, config, batch_id, mode=mode, boards_only=boards_only, deliver=deliver)
        if keep is not None:
            store.pack(keep, at=2 * keep)

    return _each_epoch(payloads, store, name, checkpoint, interval, work)
