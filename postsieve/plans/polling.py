"""One polling run: normalise → first sightings → score → store → queue → outbox.

Bodies are parsed once: the normalised batch is written before anything else reads it,
which also gives exact counts and cuts the lineage. Each later step reads only the
columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve import defaults
from postsieve.operators.alerts import SNIPPET_CHARS, alert_payloads, summary_payload
from postsieve.functions.keys import ID_DIGITS
from postsieve.functions.text import truncate
from postsieve.operators.counts import error_list, error_messages, source_counts
from postsieve.operators.dedup import ARRIVAL, BROADCAST_MAX_KEY_BYTES, CONTENT, KEY_BYTES, first_wins, new_only, with_key, without_packed
from postsieve.operators.queue import at_least, number_rows, pending
from postsieve.operators.blocklist import SCAN_MAX_PATTERNS
from postsieve.operators.scoring import Lexicon, lexicon_frame, score_listings
from postsieve.operators.sizes import at_most, in_place
from postsieve.operators.targets import apply_target_floor
from postsieve.schemas import QUARANTINE, RUNS
from postsieve.sources.registry import SourceRegistry, default_registry, normalise
from postsieve.sources.roster import roster_frame, unsupported, zero_yield
from postsieve.store.folders import ensure_checkpoint_dir
from postsieve.store.tables import DESCRIPTION_CHARS, ListingStore

MODES = ("live", "dry", "summary")
START_CHARS = 64

# Alerts that one task sorts and writes, at most; partitions that are sized by compressed
# bytes would let their memory grow with how well they compress.
OUTBOX_ROWS = 50_000

Deliver = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RunConfig:
    """What a run works with. Each value replaces its template value as a whole."""

    lexicon: DataFrame | Lexicon
    roster: DataFrame
    blocklist: Collection[str] | DataFrame = field(default_factory=lambda: list(defaults.TITLE_BLOCKLIST))
    min_score: int = defaults.MIN_SCORE
    registry: SourceRegistry = field(default_factory=default_registry)
    drop_blocked: bool = False
    mark: str = "ok"
    description_chars: int | None = DESCRIPTION_CHARS

    def resolved(self) -> RunConfig:
        """With the lexicon and blocklist looked at once, for many batches."""
        blocklist = self.blocklist
        if isinstance(blocklist, DataFrame):
            rows = at_most(blocklist.select("pattern"), SCAN_MAX_PATTERNS)
            blocklist = blocklist if rows is None else [r.pattern for r in rows if r.pattern is not None]
        return replace(self, lexicon=Lexicon.of(self.lexicon), blocklist=blocklist)

    @classmethod
    def template(cls, spark: SparkSession, **replaced) -> RunConfig:
        values = {
            "lexicon": lexicon_frame(spark, defaults.KEYWORD_WEIGHTS),
            "roster": roster_frame(spark, defaults.ROSTER),
            **replaced,
        }
        return cls(**values)


@dataclass(frozen=True)
class RunResult:
    batch_id: str
    jobs_found: int
    jobs_new: int
    jobs_alerted: int
    errors: list[str]


def new_listings(
    listings: DataFrame, stored: DataFrame, config: RunConfig, batch_rows: int | None = None, packed: Sequence[DataFrame] = ()
) -> DataFrame:
    """First sightings of a batch that the store lacks, scored and floored.

    ``packed`` are further tables of known keys, bucketed by key.

    Known keys go first, and the copies that are left compete without their descriptions:
    the start and a digest of it break the last ties. What wins is known by the digest of
    its place, and only these digests meet the wide rows: few of them, as where a batch holds
    little that is new, are brought to the rows, of which only the winners are then scored and
    moved; otherwise the wide rows move once. A short lexicon is a row's own expression, so
    rows are scored where they lie and move with no more of the description than is stored;
    a long one scores what has won.
    """
    short = [c for c in CONTENT if c != "description"]
    keyed = with_key(listings).withColumns(
        {"_start": F.left("description", F.lit(START_CHARS)), "_tie": F.sha2(F.coalesce("description", F.lit("")), 256)}
    )
    order = [*ARRIVAL, *short, "_start", "_tie"]
    place = F.sha1(F.to_json(F.struct("job_key", *order)))  # null fields are left out
    fresh = new_only(without_packed(keyed.select("job_key", *order), packed), stored, batch_rows, keys=keyed)
    ensure_checkpoint_dir(listings.sparkSession)
    winners = first_wins(fresh, order=order).select(place.alias("_place")).checkpoint()
    few = KEY_BYTES * winners.count() <= BROADCAST_MAX_KEY_BYTES
    wide, lexicon = keyed.withColumn("_place", place).drop("_start", "_tie"), Lexicon.of(config.lexicon)
    if few:
        wide = wide.join(F.broadcast(winners), "_place", "left_semi")
    in_row = lexicon.entries is not None and not isinstance(config.blocklist, DataFrame)
    if in_row:
        wide = score_listings(wide, lexicon, config.blocklist)
        if config.description_chars is not None:
            wide = wide.withColumn("description", truncate("description", config.description_chars))
    # a key has one winning place, so its rows lie together and one of them is taken there
    wide = wide if few else wide.join(in_place(winners), "_place", "left_semi")
    wide = wide.dropDuplicates(["_place"]).drop("_place")
    scored = wide if in_row else score_listings(wide, lexicon, config.blocklist, key="job_key")
    floored = apply_target_floor(scored, config.roster.select("name"))
    return floored.filter(~F.col("blocked")) if config.drop_blocked else floored


def _write_outbox(store: ListingStore, run_id: str, run_ts: datetime, config: RunConfig, mode: str) -> DataFrame:
    """The pending queue in order: keys are numbered, the bodies to post join at the end."""
    jobs, deliveries = store.queue(config.min_score)
    narrow = jobs.select("job_key", "score", "seen_at")
    order = number_rows(pending(narrow, deliveries, config.min_score)).select("job_key", "seq").checkpoint()
    # bodies are made of the rows once these are in place: the sorts hold no JSON, and no more
    # of the description than a body shows
    shown = at_least(jobs, config.min_score).withColumn("description", truncate("description", SNIPPET_CHARS + 1))
    tasks = max(store.spark.sparkContext.defaultParallelism, -(-order.count() // OUTBOX_ROWS))
    placed = shown.repartition(tasks, "job_key").join(in_place(order.repartition(tasks, "job_key")), "job_key").sortWithinPartitions("seq")
    store.replace("outbox", run_id, alert_payloads(placed, F.lit(run_ts)).withColumn("mode", F.lit(mode)))
    store.replace("steps", run_id, store.spark.range(1).select(F.lit(mode).alias("mode")))
    return store.part("outbox", run_id)


def drain_queue(
    store: ListingStore,
    run_id: str,
    run_ts: datetime,
    config: RunConfig,
    mode: str = "live",
    deliver: Deliver | None = None,
) -> int:
    """Write the pending queue to the outbox in order and record deliveries.

    ``deliver`` takes outbox rows and returns (job_id or job_key, ok); (run_id, job_key)
    can serve it as idempotency key. Without it an alert counts as delivered once it is
    in the outbox. A dry run marks its outbox rows ``dry`` and delivers nothing. A run
    that is started again keeps its outbox, and sends what no ledger entry has taken.
    Returns the number of alerts that the run has delivered so far.
    """
    if mode == "summary":
        return 0
    step = store.part("steps", run_id).first()
    written = step is not None and step["mode"] == mode
    outbox = store.part("outbox", run_id) if written else _write_outbox(store, run_id, run_ts, config, mode)
    if mode == "dry":
        return outbox.count()
    open_ = outbox.join(in_place(store.read("deliveries").select("job_key")), "job_key", "left_anti") if written else outbox
    if deliver:
        results = deliver(open_)
        if "job_key" not in results.columns:
            results = results.join(open_.select("job_key", "job_id"), "job_id")
        elif "job_id" not in results.columns:
            results = results.withColumn("job_id", F.left("job_key", F.lit(ID_DIGITS)))
    else:
        results = open_.select("job_key", "job_id", F.lit(True).alias("ok"))
    delivered = store.mark_delivered(results, run_id, run_ts, config.mark)
    return delivered.filter("ok").count()


def run_batch(
    store: ListingStore,
    payloads: DataFrame,
    config: RunConfig,
    batch_id: str,
    run_ts: datetime | None = None,
    mode: str = "live",
    boards_only: bool = False,
    deliver: Deliver | None = None,
    errors: Collection[str] = (),
) -> RunResult:
    """Process one batch of landed payloads; replaying a ``batch_id`` changes nothing.

    A replay keeps the clock of the first attempt. Listings and the run record are
    stored in every mode, with the listings per source and the endpoints that yielded
    none. ``errors`` are messages of the caller's own fetching stage; they come first in
    the run record.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    spark = store.spark
    run_ts = store.clock(batch_id, _aware(run_ts or datetime.now(timezone.utc)))

    staged = store.replace(
        "staged",
        batch_id,
        normalise(payloads, config.roster, config.registry, boards_only=boards_only),
    )
    listings = staged.filter("reason is null")
    counts = store.replace("source_counts", batch_id, source_counts(listings))
    total = counts.filter("level = 0").select("listings").first()
    jobs_found = total["listings"] if total else 0
    kinds = config.registry.board_kinds()
    store.replace("zero_yield", batch_id, zero_yield(config.roster.filter(F.col("ats").isin(*kinds)), listings))

    bad = staged.filter("reason is not null").select(*QUARANTINE.fieldNames())
    quarantine = store.replace("quarantine", batch_id, bad.unionByName(unsupported(config.roster, kinds)))

    known, packed = store.keys_before(batch_id)
    fresh = new_listings(listings, known, config, jobs_found, packed)
    jobs_new = store.append_jobs(fresh, batch_id, run_ts, config.description_chars).count()

    jobs_alerted = drain_queue(store, batch_id, run_ts, config, mode, deliver)

    found_errors = [*errors, *error_list(error_messages(quarantine)).first()["errors"]]
    finished = datetime.now(timezone.utc)
    row = (run_ts, max(finished, run_ts), jobs_found, jobs_new, jobs_alerted, found_errors)
    run = store.append_run(spark.createDataFrame([row], RUNS), batch_id)
    store.replace("summaries", batch_id, summary_payload(run, F.col("finished_at")).withColumn("mode", F.lit(mode)))
    return RunResult(batch_id, jobs_found, jobs_new, jobs_alerted, found_errors)


def _aware(ts: datetime) -> datetime:
    return ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
