import pytest
from pyspark.sql import functions as F

from helpers import payload, payload_frame
from postsieve.operators.scoring import lexicon_frame
from postsieve.plans import RunConfig
from postsieve.sources import roster_frame
from postsieve.store import ListingStore, shared_folder
from postsieve.streaming import poll, read_landing, score_epochs, score_stream
from postsieve.streaming.ingest import write_landing


def config(spark):
    return RunConfig(lexicon_frame(spark, {"juce": 6}), roster_frame(spark, [("Acme", "lever", "acme")]), ["cto"])


def board(spark, *titles):
    items = [{"text": t, "hostedUrl": f"u/{t}", "descriptionPlain": "juce"} for t in titles]
    return payload_frame(spark, payload("lever", items, "acme"))


def start(spark, store, landing, **kw):
    poll(read_landing(spark, landing), store, config(spark), "poll", f"{store.root}/progress", **kw).awaitTermination()


def test_each_start_handles_what_arrived_since(spark, tmp_path):
    store, landing = ListingStore(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    write_landing(board(spark, "A", "B"), landing)
    start(spark, store, landing)
    assert store.read("jobs").count() == 2 and store.read("outbox").count() == 2
    start(spark, store, landing)
    assert store.read("runs").count() == 1
    write_landing(board(spark, "B", "C", "CTO"), landing)
    start(spark, store, landing)
    runs = store.read("runs").orderBy("run_id").collect()
    assert [(r.jobs_found, r.jobs_new, r.jobs_alerted) for r in runs] == [(2, 2, 2), (3, 2, 1)]
    assert sorted(r.title for r in store.read("jobs").collect()) == ["A", "B", "C", "CTO"]
    assert store.read("outbox").groupBy("job_id").count().filter("count > 1").count() == 0


def test_scores_in_the_stream(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    write_landing(board(spark, "A", "CTO", "A"), landing)
    query = (
        score_stream(read_landing(spark, landing), config(spark))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out).orderBy("src_pos").collect()
    assert [(r.title, r.score, r.blocked) for r in rows] == [("A", 6, False), ("CTO", 1, True), ("A", 6, False)]


@pytest.mark.parametrize("phrases,patterns", [(64, 256), (65, 257), (1500, 600)])
def test_any_lexicon_and_blocklist_stream(spark, tmp_path, phrases, patterns):
    store, landing = ListingStore(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    write_landing(board(spark, "A", "CTO now", "B"), landing)
    weights = {"juce": 6, **{f"zq{i} engineer": 1 for i in range(phrases - 1)}}
    blocked = ["cto", *[f"zz{i}" for i in range(patterns - 1)]]
    long = RunConfig(lexicon_frame(spark, weights), roster_frame(spark, [("Acme", "lever", "acme")]), blocked)
    score_epochs(read_landing(spark, landing), store, long, "scores", f"{store.root}/progress").awaitTermination()
    rows = store.read("scored").orderBy("src_pos").collect()
    assert [(r.title, r.score, r.blocked) for r in rows] == [("A", 6, False), ("CTO now", 1, True), ("B", 6, False)]
    if phrases > 64:
        with pytest.raises(ValueError, match="stream"):
            score_stream(read_landing(spark, landing), long)


def test_an_epoch_that_runs_again_replaces_its_scores(spark, tmp_path):
    store, landing = ListingStore(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    progress = tmp_path / "store" / "progress"
    for title in ("A", "B"):
        write_landing(board(spark, title), landing)
        score_epochs(read_landing(spark, landing), store, config(spark), "scores", str(progress)).awaitTermination()
    before = sorted(store.read("scored").collect())
    (last,) = [f for f in (progress / "commits").iterdir() if f.name == "1"]
    last.unlink()  # as if the query had died after writing and before committing
    (progress / "commits" / ".1.crc").unlink(missing_ok=True)
    score_epochs(read_landing(spark, landing), store, config(spark), "scores", str(progress)).awaitTermination()
    assert sorted(store.read("scored").collect()) == before and len(before) == 2


def test_a_long_lexicon_parses_an_epoch_once(spark, tmp_path, monkeypatch):
    """Listings that are read twice are written, numbered, and removed after the epoch."""
    from postsieve.streaming import ingest

    store, landing = ListingStore(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    write_landing(board(spark, "A", "A", "B"), landing)
    write_landing(board(spark, "A"), landing)
    plans, score = [], ingest.score_listings

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return score(df, *args, **kwargs)

    monkeypatch.setattr(ingest, "score_listings", seen)
    long = RunConfig(lexicon_frame(spark, {"juce": 6, **{f"zq{i} engineer": 1 for i in range(64)}}), roster_frame(spark, [("Acme", "lever", "acme")]), [])
    score_epochs(read_landing(spark, landing, max_files=1), store, long, "scores", f"{store.root}/progress").awaitTermination()
    assert len(plans) == 2 and not any("from_json" in p or "Generate" in p for p in plans)
    assert sorted((r.title, r.score) for r in store.read("scored").collect()) == [("A", 6), ("A", 6), ("A", 6), ("B", 6)]
    assert not list((tmp_path / "store" / "listings").iterdir())


def test_live_polling_sends_each_listing_once(spark, tmp_path):
    """Several epochs, a restart and packing in between; deliveries go with the epoch."""
    store, landing = ListingStore(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    sent = []

    def deliver(rows):
        sent.extend(r.job_key for r in rows.collect())
        return rows.select("job_key", F.lit(True).alias("ok"))

    for day in range(5):
        write_landing(board(spark, "A", f"B{day}"), landing)
        start(spark, store, landing, deliver=deliver, keep=1)
    assert len(sent) == len(set(sent)) == 6 == store.read("deliveries").count() == store.read("jobs").count()
    assert [r.jobs_alerted for r in store.read("runs").orderBy("run_id").collect()] == [2, 1, 1, 1, 1]
    assert len(store.packs.names()) > 0


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_compacted_landing_follows_its_size_and_not_its_tasks(spark, tmp_path):
    """Sixteen tasks land two kinds: a file each, with all rows, and no more on a second day."""
    landing, plain = tmp_path / "landing", tmp_path / "plain"
    boards = board(spark, "A").unionByName(payload_frame(spark, payload("remote ok/=", [], None)))
    rows = boards.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(64)))).repartition(16, "n").drop("n")
    for _ in range(2):
        write_landing(rows, str(landing), compact=True)
        write_landing(rows, str(plain))
    files = lambda folder: len(list(folder.rglob("*.parquet")))
    assert files(landing) == 4 < files(plain)
    assert [f.name for f in sorted(landing.glob("*="))] == [f.name for f in sorted(plain.glob("*="))]
    stored = [sorted(map(str, spark.read.parquet(str(f)).collect())) for f in (landing, plain)]
    assert stored[0] == stored[1] and len(stored[0]) == 256
    assert not list((tmp_path / "landing-scattered").iterdir())


def test_an_epoch_is_dealt_by_endpoint_not_by_file(spark, tmp_path):
    """All pages of a feed lie in one small file; the listings are not made by one task."""
    store, landing = ListingStore(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    pages = [payload("remoteok", [{}, {"position": f"t{i}", "url": f"u{i}"}], endpoint_ord=i) for i in range(200)]
    write_landing(payload_frame(spark, *pages), landing, compact=True)
    assert len(list((tmp_path / "landing").rglob("*.parquet"))) == 1
    start(spark, store, landing, mode="summary")
    files = store.read("staged").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 200 and len(files) >= 8 and max(r["count"] for r in files) < 50
    assert store.read("jobs").count() == 200
