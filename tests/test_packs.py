"""A packed store shows the same rows, queue and first sightings as an unpacked one."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import payload, payload_frame
from postsieve.operators.dedup import without_packed
from postsieve.operators.scoring import lexicon_frame
from postsieve.plans import RunConfig, run_batch
from postsieve.sources import roster_frame
from postsieve.store import ListingStore, packs
from postsieve.store.folders import children, mark
from postsieve.store.tables import TABLES

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def config(spark):
    return RunConfig(lexicon_frame(spark, {"juce": 6}), roster_frame(spark, [("Acme", "lever", "acme")]), ["cto"])


def board(spark, *titles):
    items = [{"text": t, "hostedUrl": f"u/{t}", "descriptionPlain": "juce" if t != "plain" else "x"} for t in titles]
    return payload_frame(spark, payload("lever", items, "acme"))


def run(store, config, i, *titles, **kw):
    return run_batch(store, board(store.spark, *titles), config, f"b{i}", T0 + timedelta(days=i), **kw)


def shown(store):
    tables = ("jobs", "deliveries", "outbox", "runs")
    return {t: sorted(map(str, store.read(t).drop("finished_at", "payload").collect())) for t in tables}


def half(rows):
    return rows.select("job_key", (F.conv(F.left("job_key", F.lit(1)), 16, 10).cast("int") % 2 == 0).alias("ok"))


def test_packing_changes_nothing_that_is_read(spark, tmp_path, config, monkeypatch):
    monkeypatch.setattr("postsieve.store.tables.MAX_PACKS", 1)
    plain, packed = (ListingStore(spark, str(tmp_path / n)) for n in ("plain", "packed"))
    for i in range(4):
        titles = ["plain", f"t{i}", f"t{i // 2}", f"s{i}", "CTO"]
        assert run(plain, config, i, *titles, deliver=half) == run(packed, config, i, *titles, deliver=half)
        packed.pack(keep=1)
        assert i % 2 or shown(packed) == shown(plain)
        assert len(children(spark, packed.path("jobs"))) <= 2 and len(packed.packs.names()) <= 2
    assert packed.read("staged").select("batch_id").distinct().count() == 1
    # a replay of a packed batch finds its clock, its listings and its ledger
    again = [run(s, config, 0, "plain", "t0", "s0", "CTO") for s in (plain, packed)]
    assert again[0] == again[1] and shown(packed) == shown(plain)
    packed.pack(keep=0)
    assert shown(packed) == shown(plain)
    assert run(plain, config, 9, "t0", "new") == run(packed, config, 9, "t0", "new") and shown(packed) == shown(plain)


def test_a_pack_left_half_way_is_not_seen_and_not_doubled(spark, tmp_path, config, monkeypatch):
    store = ListingStore(spark, str(tmp_path))
    for i in range(3):
        run(store, config, i, f"t{i}")
    before = shown(store)
    monkeypatch.setattr(packs, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.pack(keep=1)
    assert shown(store) == before and store.packs.names() == []
    monkeypatch.setattr(packs, "mark", mark)
    monkeypatch.setattr("postsieve.store.tables.remove", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.pack(keep=1)
    assert shown(store) == before and len(store.packs.names()) == 1
    monkeypatch.undo()
    assert run(store, config, 1, "t1").jobs_new == 1 and shown(store) == before
    store.pack(keep=0)
    assert shown(store) == before and run(store, config, 5, "t0", "t1", "t2", "t5").jobs_new == 1


def test_packed_keys_are_read_where_they_lie(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    for i in range(2):
        run(store, config, i, f"t{i}")
    store.pack(keep=0)
    live, known = store.keys_before("b7")
    batch = spark.createDataFrame([("x",)], "job_key string").repartition(3)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = without_packed(batch, known)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    history = plan[plan.rindex("+- Sort") :]  # the second side of the join
    assert "Bucketed: true" in plan and plan.count("Exchange") == 2  # both of the batch: its own and the one to the buckets
    assert "Bucketed: true" in history and "Exchange" not in history
    assert live.count() == 0 and known[0].count() == 2


def test_the_queue_reads_the_snapshot_and_what_lies_apart(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    for i in range(3):
        run(store, config, i, f"t{i}", "plain", mode="summary")
    store.pack(keep=1)
    jobs, ledger = store.queue(1)
    files = [r[0] for r in jobs.select(F.input_file_name()).distinct().collect()]
    assert {r.title for r in jobs.filter("score > 0").collect()} == {"t0", "t1", "t2", "plain"}
    assert all("packs/pending" in f or "jobs/batch_id=b2" in f for f in files)
    assert store.queue(0)[0].count() == store.read("jobs").count() == 4
    assert run(store, config, 4, "t4").jobs_alerted == 4  # the low score waits on
    store.pack(keep=0)
    assert [r.title for r in store.queue(1)[0].collect()] == ["plain"] and run(store, config, 5, "t5").jobs_alerted == 1


def test_keys_are_found_by_a_session_that_did_not_write_them(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    run(store, config, 0, "t0", "t1", mode="summary")
    store.pack(keep=0)
    spark.sql(f"DROP TABLE {store.packs._table(store.packs.names()[0])}")  # as a new catalog has none
    again = ListingStore(spark, str(tmp_path))
    assert run(again, config, 1, "t0", "t2", mode="summary").jobs_new == 1


def test_files_stay_few(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    files = []
    for i in range(5):
        run(store, config, i, f"t{i}", mode="summary")
        store.pack(keep=1, at=2)
        files.append(sum(len(children(spark, f"{store.path(t)}")) for t in TABLES))
    assert max(files) <= 2 * len(TABLES) + len(TABLES) and store.read("jobs").count() == 5
