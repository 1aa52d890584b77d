"""One function per registered query: (spark, sf_dir) → DataFrame."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from postsieve import functions as fn
from postsieve.operators.alerts import alert_payloads
from postsieve.operators.counts import error_list, error_messages, source_counts
from postsieve.operators.dedup import first_wins, new_only, with_key
from postsieve.operators.queue import at_least, number_rows, pending
from postsieve.operators.blocklist import blocked_by_title, grams
from postsieve.operators.scoring import Lexicon, score_listings
from postsieve.operators.sizes import in_place
from postsieve.operators.targets import apply_target_floor, only_targets
from postsieve.plans import audit, run_batch
from postsieve.schemas import RAW_PAYLOAD
from postsieve.sources import default_registry, first_endpoints, normalise, unsupported, zero_yield
from postsieve.sources.explode import staged
from postsieve.sources.feeds import file_payloads
from postsieve.sources.registry import Source
from postsieve.store import ListingStore, shared_folder
from postsieve.streaming.ingest import poll, read_landing, score_epochs, score_stream, write_landing

RUN_TS = datetime(2026, 1, 1, tzinfo=timezone.utc)
BOARD_COLUMNS = ("token", "title", "company", "location", "url", "source", "description")


def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    text = fn.strip_html("html")
    return v.table(spark, sf, "pages").select("page_id", text.alias("text")).withColumn("chars", F.length("text"))


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    talk = v.table(spark, sf, "conversations")
    company, title = fn.split_title(F.concat_ws(": ", "role", "text"))
    return talk.select(
        "conv_id",
        "turn",
        company.alias("company"),
        F.md5(title).alias("title_md5"),
        F.md5(fn.search_text("role", F.lit(""), "text")).alias("search_md5"),
        fn.snippet("text").alias("snippet"),
        F.length(fn.truncate("text", 2000)).alias("kept"),
        fn.or_default(F.nullif(F.col("role"), F.lit("user")), "none").alias("role_or_none"),
    )


def job_key(spark: SparkSession, sf: str) -> DataFrame:
    return with_key(v.listings(spark, sf)).select("doc_id", "job_id")


def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return first_wins(with_key(v.listings(spark, sf))).select("job_id", "doc_id", "source", "title")


def blocklist_filter(spark: SparkSession, sf: str) -> DataFrame:
    return blocked_by_title(v.listings(spark, sf), v.BLOCKLIST).select("doc_id", "blocked")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "score", fn.render_list("keywords").alias("keywords"))


def score_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(score_listings(v.listings(spark, sf), v.lexicon(spark), v.BLOCKLIST))


def score_phrases_joined(spark: SparkSession, sf: str) -> DataFrame:
    joined = Lexicon.of(v.lexicon(spark), scan_max=0)
    return _scored(score_listings(v.listings(spark, sf), joined, v.BLOCKLIST, key="doc_id"))


def score_long_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(score_listings(v.listings(spark, sf), v.word_lexicon(spark, sf), key="doc_id"))


def score_shared_words(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon of word pairs in which all phrases share their words."""
    return _scored(score_listings(v.listings(spark, sf), v.pair_lexicon(spark, sf), key="doc_id"))


def score_phrases_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """The form of a lexicon too large to be broadcast."""
    shuffled = replace(Lexicon.of(v.lexicon(spark), scan_max=0), fits_broadcast=False)
    return _scored(score_listings(v.listings(spark, sf), shuffled, v.BLOCKLIST))


def score_target_floor(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_listings(v.listings(spark, sf), v.lexicon(spark), v.BLOCKLIST)
    floored = apply_target_floor(scored, v.targets(spark))
    return floored.select("doc_id", "blocked", "is_target", "score", fn.render_list("keywords").alias("keywords"))


def target_listings(spark: SparkSession, sf: str) -> DataFrame:
    return only_targets(v.listings(spark, sf), v.targets(spark)).select("doc_id", "company")


def tier_label(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_listings(v.listings(spark, sf), v.lexicon(spark), v.BLOCKLIST)
    return scored.select("doc_id", "score", fn.tier_label().alias("tier"), fn.tier_colour().alias("colour"))


def threshold_filter(spark: SparkSession, sf: str) -> DataFrame:
    return at_least(v.jobs(spark, sf), 5).select("job_id", "score")


def pending_alerts(spark: SparkSession, sf: str) -> DataFrame:
    delivered = v.labelled_keys(spark, sf, quality=1)
    jobs = v.jobs(spark, sf).select("job_key", "job_id", "score", "seen_at", "keywords", "title")
    return number_rows(pending(jobs, delivered, 5)).select(
        "seq", "job_id", "score", fn.tier_label().alias("tier"), fn.render_list("keywords").alias("keywords"), "title"
    )


def new_listings(spark: SparkSession, sf: str) -> DataFrame:
    firsts = first_wins(with_key(v.listings(spark, sf)))
    return new_only(firsts, v.labelled_keys(spark, sf)).select("job_id", "doc_id")


def _board(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = v.registry().apply(kind, v.board_payloads(spark, sf, kind), v.page_roster(spark, sf))
        return rows.select(*BOARD_COLUMNS)

    return query


def feed_remoteok(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.registry().apply("remoteok", v.board_payloads(spark, sf, "remoteok"))
    return rows.select("title", "company", "location", "url", "source", "description")


def feed_title_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = default_registry().apply("wwr", v.wwr_payloads(spark, sf))
    return rows.select("title", "company", "location", "url", "source", "description")


def feed_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    rows = default_registry().apply("avixa", v.avixa_payloads(spark, sf))
    return rows.select("title", "company", "location", "url", "source", "description")


def source_union_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalise(v.all_payloads(spark, sf), v.page_roster(spark, sf), v.registry()).filter("reason is null")
    counts = source_counts(rows)
    return counts.select("level", "source_kind", F.col("endpoint_ord").cast("string").alias("endpoint_ord"), "listings")


def source_union_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalise(v.all_payloads(spark, sf), v.page_roster(spark, sf), v.registry(), boards_only=True)
    return rows.filter("reason is null").select("source_kind", "endpoint_ord", "src_pos", "title")


def roster_dedup(spark: SparkSession, sf: str) -> DataFrame:
    customer = v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    roster = customer.select(
        F.col("c_custkey").cast("int").alias("ord"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("ats"),
        F.col("n_name").alias("token"),
    )
    return first_endpoints(roster)


def roster_routing(spark: SparkSession, sf: str) -> DataFrame:
    roster = v.customer_roster(spark, sf)
    registry = default_registry()
    rows = normalise(v.customer_payloads(spark, sf), roster, boards_only=True)
    columns = ("source_kind", "token", "reason", "detail")
    listed = rows.select(*columns, "title", "company", "url")
    none = F.lit(None).cast("string")
    odd = unsupported(roster, registry.board_kinds()).select(
        *columns, none.alias("title"), none.alias("company"), none.alias("url")
    )
    return listed.unionByName(odd)


def run_errors(spark: SparkSession, sf: str) -> DataFrame:
    bad = roster_routing(spark, sf).filter("reason is not null")
    errors = error_list(error_messages(bad))
    return errors.select(
        F.size("errors").alias("n"),
        fn.render_list("errors", "; ").alias("errors"),
        fn.render_list("errors", "\n", first=3).alias("first_errors"),
    )


def zero_yield_report(spark: SparkSession, sf: str) -> DataFrame:
    roster = v.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("ord"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("ats"),
        F.col("c_custkey").cast("string").alias("token"),
    )
    orders = v.table(spark, sf, "orders")
    segment = v.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("source_kind"))
    found = orders.join(segment, F.col("o_custkey") == F.col("c_custkey")).select(
        "source_kind", F.col("o_custkey").cast("string").alias("token")
    )
    return zero_yield(roster, found).select("ord", "label")


def _audit(spark: SparkSession, sf: str):
    return audit(*v.document_probes(spark, sf))


def health_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).endpoints


def health_tally(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).tally


def health_repair(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).repairs


def health_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).unsupported.select("source_kind", "token", "reason", "detail")


def alert_payload(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embed")
    value = lambda i: F.get(e["fields"], F.lit(i))["value"]
    return alert_payloads(v.jobs(spark, sf), F.lit(RUN_TS)).select(
        "job_id",
        e["title"].alias("title"),
        e["url"].alias("url"),
        e["color"].alias("color"),
        value(0).alias("company"),
        value(1).alias("location"),
        value(2).alias("score"),
        value(3).alias("source"),
        value(4).alias("keywords"),
        value(5).alias("description"),
        e["timestamp"].alias("stamp"),
        F.get_json_object("payload", "$.embeds[0].fields[2].name").alias("third_field"),
    )


def _store(spark: SparkSession) -> ListingStore:
    return ListingStore(spark, f"{shared_folder(spark)}/postsieve/{uuid.uuid4().hex}")


def _after_run(spark: SparkSession, sf: str, mode: str = "live") -> ListingStore:
    """A store after one run over all payloads; the listings it delivers are ledgered."""
    store = _store(spark)
    landing = store.path("landing")
    write_landing(v.all_payloads(spark, sf), landing)
    payloads = spark.read.parquet(landing)
    run_batch(store, payloads, _config(store, sf), "b1", RUN_TS, mode)
    return store


def _config(store: ListingStore, sf: str):
    """The run configuration with its roster stored as a table, as an installation has it."""
    path = store.path("roster")
    v.page_roster(store.spark, sf).write.mode("overwrite").parquet(path)
    return v.run_config(store.spark, store.spark.read.parquet(path))


def stored_listings(spark: SparkSession, sf: str) -> DataFrame:
    return _after_run(spark, sf).read("jobs").select(
        "job_id", "title", "company", "location", "url", "source", "score", "blocked", "is_target",
        fn.render_list("keywords").alias("keywords"), F.length("description").alias("kept"),
        F.md5("description").alias("description_md5"),
    )


def outbox_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _after_run(spark, sf, "dry").read("outbox").select(
        "seq", "job_id", "score", "mode", F.get_json_object("payload", "$.embeds[0].title").alias("title")
    )


def blocklist_long(spark: SparkSession, sf: str) -> DataFrame:
    """Titles against the long words of the benchmark items, several hundred patterns."""
    patterns = v.word_lexicon(spark, sf).filter("ord >= 7").select(F.col("phrase").alias("pattern"))
    return blocked_by_title(v.listings(spark, sf), patterns).select("doc_id", "blocked")


def blocklist_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Titles against every run of five characters of the benchmark items: thousands of
    patterns, most of them in many titles' words."""
    pieces = v.table(spark, sf, "benchmark").select(F.explode(grams(F.lower("text"), 5)).alias("pattern"))
    return blocked_by_title(v.listings(spark, sf), pieces).select("doc_id", "blocked")


def source_registered(spark: SparkSession, sf: str) -> DataFrame:
    """A source of the caller's own, registered beside the others and run with them."""

    def plain_pages(payloads: DataFrame) -> DataFrame:
        lines = payloads.select(
            "source_kind", "token", "endpoint", "src_rank", "endpoint_ord", F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("_raw"),
            F.posexplode(F.split("body", "\n")).alias("src_pos", "line"),
        )
        link = F.concat_ws("#", "token", "src_pos")
        nothing = F.lit("")
        return staged(lines, title=F.col("line"), company=F.col("token"), location=nothing, url=link, source=F.lit("Plain"), description=nothing)

    registry = default_registry().register(Source("plain", plain_pages, 9))
    values = {"token": F.col("doc_id"), "body": F.col("text"), "source_kind": F.lit("plain")}
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAYLOAD.fields]
    own = v.table(spark, sf, "documents").select(*columns)
    rows = normalise(own.unionByName(v.wwr_payloads(spark, sf)), v.page_roster(spark, sf), registry, kinds=("wwr", "plain"))
    return rows.select("source_kind", "source", "company", "url", F.md5("title").alias("title_md5"), "src_pos")


def feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Feed files read as a stream; what cannot be read of them goes to quarantine."""
    store = _store(spark)
    path, out = store.path("feeds"), store.path("items")
    v.broken_feed_files(spark, sf, path)
    rows = default_registry().apply("wwr", file_payloads(spark, path, "wwr", stream=True))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", store.path("progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("title", "company", "url", "description", "reason", "raw")


def store_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """A store that is created, appended to, and created again."""
    store = _store(spark)
    store.bootstrap()
    run_batch(store, v.wwr_payloads(spark, sf), _config(store, sf), "b1", RUN_TS)
    store.bootstrap()
    counted = [store.read(t).select(F.lit(t).alias("what")) for t in ("jobs", "deliveries", "outbox", "runs", "clocks")]
    return reduce(DataFrame.unionByName, counted).groupBy("what").agg(F.count("*").alias("n"))


def store_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches, packed on the way: three are stored, the last one sends all that waits."""
    store = _store(spark)
    config = _config(store, sf)
    for kind, mode in (("remoteok", "summary"), ("greenhouse", "summary"), ("lever", "summary"), ("wwr", "live")):
        rows = v.wwr_payloads(spark, sf) if kind == "wwr" else v.board_payloads(spark, sf, kind)
        run_batch(store, rows, config, kind, RUN_TS, mode)
        store.pack(keep=1, at=2)
    found = store.read("jobs").select("job_id", F.col("batch_id").alias("found_by"))
    return store.read("outbox").join(in_place(found), "job_id").select("run_id", "seq", "job_id", "score", "found_by")


def stream_live(spark: SparkSession, sf: str) -> DataFrame:
    """A live poll over several epochs, then a restart to which everything is landed again:
    each listing is sent once. Old epochs are packed on the way."""
    store = _store(spark)
    landing, config = store.path("landing"), _config(store, sf)
    for feeds in ([v.wwr_payloads], [v.wwr_payloads, v.avixa_payloads]):
        for feed in feeds:
            write_landing(feed(spark, sf), landing, compact=True)
        poll(read_landing(spark, landing, max_files=2), store, config, "live", store.path("progress"), keep=2).awaitTermination()
    sent = store.read("outbox").groupBy("job_id").agg(F.count("*").alias("sent"))
    done = store.read("deliveries").groupBy("job_id").agg(F.count("*").alias("delivered"))
    return sent.join(done, "job_id", "full").select("job_id", "sent", "delivered")


def store_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, then the first one again: its outbox and ledger are as they were."""
    store = _store(spark)
    config = _config(store, sf)
    landing = store.path("landing")
    write_landing(v.all_payloads(spark, sf), landing)
    payloads = spark.read.parquet(landing)
    feed = payloads.filter("source_kind = 'remoteok'")
    for batch, rows, mode in (("b1", feed, "live"), ("b2", payloads, "summary"), ("b1", feed, "live")):
        run_batch(store, rows, config, batch, RUN_TS, mode)
    sent = store.read("deliveries").select("job_id", "ok", F.col("run_id").alias("delivered_by"))
    return store.read("outbox").join(sent, "job_id", "left").select("run_id", "seq", "job_id", "score", "ok", "delivered_by")


def run_zero_yield(spark: SparkSession, sf: str) -> DataFrame:
    """A run whose landing lacks the boards of two kinds: their endpoints are reported."""
    store = _store(spark)
    rows = v.board_payloads(spark, sf, "greenhouse").unionByName(v.board_payloads(spark, sf, "remoteok"))
    run_batch(store, rows, _config(store, sf), "b1", RUN_TS, "summary")
    return store.read("zero_yield").select("ord", "label")


def run_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The listings per source that a run records."""
    counts = _after_run(spark, sf, "summary").read("source_counts")
    return counts.select("level", "source_kind", F.col("endpoint_ord").cast("string").alias("endpoint_ord"), "listings")


def quarantine_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a run over good, gone, failing and cut-off responses puts aside."""
    store = _store(spark)
    path = store.path("roster")
    v.customer_roster(spark, sf).write.parquet(path)
    config = v.run_config(spark, spark.read.parquet(path))
    run_batch(store, v.customer_payloads(spark, sf), config, "b1", RUN_TS, "summary")
    return store.read("quarantine").select("source_kind", "token", "endpoint_ord", "reason", "detail", "raw")


def stream_scored_long_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A stream scored against every word of the benchmark items."""
    store = _store(spark)
    landing, path = store.path("landing"), store.path("lexicon")
    write_landing(v.board_payloads(spark, sf, "remoteok"), landing, compact=True)
    v.word_lexicon(spark, sf).write.parquet(path)
    config = replace(_config(store, sf), lexicon=spark.read.parquet(path), blocklist=[])
    score_epochs(read_landing(spark, landing, max_files=4), store, config, "scores", store.path("progress")).awaitTermination()
    return store.read("scored").select("job_id", "source", "endpoint_ord", "src_pos", "score")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    store = _after_run(spark, sf)
    field = lambda i: F.get_json_object("payload", f"$.embeds[0].fields[{i}].value")
    return store.read("summaries").select(
        field(0).alias("started"),
        field(1).alias("found"),
        field(2).alias("new"),
        field(3).alias("alerted"),
        field(4).alias("errors"),
        F.get_json_object("payload", "$.embeds[0].color").alias("color"),
    )


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """All payloads as files, polled a few files at a time, then all over again."""
    store = _store(spark)
    landing = store.path("landing")
    config = _config(store, sf)
    write_landing(v.all_payloads(spark, sf), landing, compact=True)
    for name in ("first", "again"):
        stream = read_landing(spark, landing, max_files=8)
        poll(stream, store, config, name, f"{store.root}/progress-{name}", mode="summary").awaitTermination()
    return store.read("jobs").select("job_id", "url")


def stream_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Payload files scored in the stream and written by a file sink, copies included."""
    store = _store(spark)
    landing, out = store.path("landing"), store.path("scores")
    write_landing(v.all_payloads(spark, sf), landing)
    scored = score_stream(read_landing(spark, landing), _config(store, sf))
    query = (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", store.path("progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).select("job_id", "source", "src_pos", "score")


QUERIES = {
    "strip_html": strip_html,
    "text_functions": text_functions,
    "job_key": job_key,
    "dedup_first_wins": dedup_first_wins,
    "blocklist_filter": blocklist_filter,
    "score_phrases": score_phrases,
    "score_phrases_joined": score_phrases_joined,
    "score_long_lexicon": score_long_lexicon,
    "score_shared_words": score_shared_words,
    "score_phrases_shuffled": score_phrases_shuffled,
    "score_target_floor": score_target_floor,
    "target_listings": target_listings,
    "tier_label": tier_label,
    "threshold_filter": threshold_filter,
    "pending_alerts": pending_alerts,
    "new_only": new_listings,
    "board_roundtrip_greenhouse": _board("greenhouse"),
    "board_roundtrip_lever": _board("lever"),
    "board_roundtrip_ashby": _board("ashby"),
    "feed_remoteok": feed_remoteok,
    "feed_title_split": feed_title_split,
    "feed_fallbacks": feed_fallbacks,
    "source_union_counts": source_union_counts,
    "source_union_subset": source_union_subset,
    "roster_dedup": roster_dedup,
    "roster_routing": roster_routing,
    "run_errors": run_errors,
    "zero_yield": zero_yield_report,
    "health_audit": health_audit,
    "health_tally": health_tally,
    "health_repair": health_repair,
    "health_unsupported": health_unsupported,
    "alert_payload": alert_payload,
    "stored_listings": stored_listings,
    "outbox_rows": outbox_rows,
    "run_summary": run_summary,
    "blocklist_long": blocklist_long,
    "blocklist_pieces": blocklist_pieces,
    "source_registered": source_registered,
    "feed_files": feed_files,
    "store_bootstrap": store_bootstrap,
    "store_packed": store_packed,
    "stream_live": stream_live,
    "store_replay": store_replay,
    "run_zero_yield": run_zero_yield,
    "run_source_counts": run_source_counts,
    "quarantine_rows": quarantine_rows,
    "stream_scored_long_lexicon": stream_scored_long_lexicon,
    "stream_first_seen": stream_first_seen,
    "stream_scored": stream_scored,
}
