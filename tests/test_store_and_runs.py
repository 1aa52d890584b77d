import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from helpers import listing, listing_frame, payload, payload_frame, rss
from postsieve.operators.alerts import alert_payloads, summary_payload
from postsieve.operators.dedup import first_wins, new_only, with_key
from postsieve.operators.queue import at_least, number_rows, pending
from postsieve.operators.scoring import lexicon_frame
from postsieve.plans import RunConfig, new_listings, polling, run_batch
from postsieve.schemas import RUNS
from postsieve.sources import roster_frame
from postsieve.store import ListingStore

T1 = datetime(2026, 1, 1, 0, 0, tzinfo=timezone.utc)
T2 = datetime(2026, 1, 2, 0, 0, tzinfo=timezone.utc)


def test_first_wins_does_not_depend_on_partitioning(spark):
    rows = [
        listing("Dev", "Acme", "u", location=f"{r}-{e}-{p}", rank=r, endpoint=e, pos=p)
        for r in (3, 1, 2)
        for e in (2, 1)
        for p in (5, 4, 6)
    ] + [listing("DEV", "ACME", "u", rank=9), listing("Dev", "Acme", "U", rank=9)]
    df = with_key(listing_frame(spark, *rows))
    for n in (1, 3, 8):
        out = first_wins(df.repartition(n)).collect()
        assert sorted((r.url, r.location) for r in out) == [("U", ""), ("u", "1-1-4")]


def test_first_wins_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("job_key"), F.col("id").alias("src_pos"))
    plan = first_wins(df, order=("src_pos",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("rows", [None, 10])
def test_new_only(spark, rows):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "job_key string, x int")
    store = spark.createDataFrame([("b",), ("z",)], "job_key string")
    assert {r.job_key for r in new_only(batch, store, rows).collect()} == {"a", "c"}


def test_an_endpoint_landed_twice_gives_one_fixed_winner(spark, config):
    rows = [listing("A", "Acme", "u", description=d, location=loc) for d in ("x", "y") for loc in ("p", "o")]
    for n in (1, 2, 4):
        stored = spark.createDataFrame([], "job_key string")
        out = new_listings(listing_frame(spark, *rows).repartition(n), stored, config, 4).collect()
        assert [(r.location, r.description) for r in out] == [("o", "x")]


def queue_rows(spark, n):
    df = spark.range(n).select(
        F.left(F.sha1(F.col("id").cast("string")), F.lit(16)).alias("job_key"),
        F.when(F.col("id") % 3 == 0, 5).otherwise((F.col("id") % 7).cast("int")).cast("int").alias("score"),
        F.timestamp_seconds(F.col("id") % 2).alias("seen_at"),
    )
    return df


@pytest.mark.parametrize("digits", [1, 3])
def test_number_rows_is_the_position_in_the_global_order(spark, digits):
    df = queue_rows(spark, 2000)
    got = {r.job_key: r.seq for r in number_rows(df, digits=digits).collect()}
    ordered = sorted(df.collect(), key=lambda r: (r.score, r.seen_at, r.job_key))
    assert got == {r.job_key: i for i, r in enumerate(ordered, 1)}
    assert number_rows(df.limit(0)).count() == 0


def test_number_rows_has_no_task_over_all_rows(spark):
    plan = number_rows(queue_rows(spark, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "rangepartitioning" not in plan


def test_pending(spark):
    jobs = spark.createDataFrame([("a", 5), ("b", 9), ("c", 4), ("d", 5)], "job_key string, score int")
    ledger = spark.createDataFrame([("b",), ("b",)], "job_key string")
    assert {r.job_key for r in pending(jobs, ledger, 5).collect()} == {"a", "d"}
    assert at_least(jobs, 9).count() == 1


def test_alert_payload(spark):
    schema = "title string, company string, location string, url string, source string, score int, keywords array<string>, description string"
    rows = [
        ("T", "C", "", "u", "s", 20, ["a", "b"], "x" * 301),
        ("T", "C", "Oslo", "u", None, 0, [], ""),
    ]
    out = alert_payloads(spark.createDataFrame(rows, schema), F.lit(T1)).collect()
    first, second = (json.loads(r.payload)["embeds"][0] for r in out)
    assert first["color"] == 65280 and first["footer"] == {"text": "listing alerts"}
    assert first["timestamp"] == "2026-01-01T00:00:00+00:00"
    assert [(f["name"], f["value"], f["inline"]) for f in first["fields"]] == [
        ("Company", "C", True),
        ("Location", "Not listed", True),
        ("Score", "20 — Excellent Match", True),
        ("Source", "s", True),
        ("Keywords Matched", "a, b", False),
        ("Description", "x" * 300 + "…", False),
    ]
    assert [f["value"] for f in second["fields"]] == ["C", "Oslo", "0 — Target Company", "unknown", "none", "No description"]


@pytest.mark.parametrize("errors,colour,shown", [([], 65280, "None"), ([f"e{i}" for i in range(11)], 16739125, "\n".join(f"e{i}" for i in range(10)))])
def test_summary_payload(spark, errors, colour, shown):
    run = spark.createDataFrame([(T1, T2, 3, 2, 1, errors)], RUNS)
    embed = json.loads(summary_payload(run, F.lit(T2)).first().payload)["embeds"][0]
    assert embed["color"] == colour
    assert [f["value"] for f in embed["fields"]] == ["2026-01-01T00:00:00+00:00", "3", "2", "1", shown]


def board(*titles):
    return [{"text": t, "hostedUrl": f"u/{t}", "descriptionPlain": d} for t, d in titles]


@pytest.fixture()
def config(spark):
    return RunConfig.template(
        spark,
        lexicon=lexicon_frame(spark, {"audio dsp": 7, "juce": 5}),
        roster=roster_frame(spark, [("Acme", "lever", "acme"), ("Gone", "ashby", "gone"), ("Odd", "workday", "odd")]),
        blocklist=["cto"],
    )


def first_batch(spark):
    return payload_frame(
        spark,
        payload("lever", board(("A", "audio dsp"), ("B", "none"), ("CTO", "audio dsp"), ("A", "audio dsp")), "acme"),
        payload("ashby", None, "gone", status=404),
        payload("remoteok", [{}, {"position": "R", "company": "X", "url": "r", "description": "juce " + "x" * 3000}]),
        payload("wwr", "garbage"),
    )


def table(store, name, *columns):
    return sorted(tuple(r) for r in store.read(name).select(*columns).collect())


def test_two_runs_and_a_replay(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    one = run_batch(store, first_batch(spark), config, "b1", T1)
    assert (one.jobs_found, one.jobs_new, one.jobs_alerted) == (5, 4, 2)
    assert one.errors == ["roster failed: unsupported_kind (1)", "wwr failed: unparseable_body (1)"]
    assert table(store, "jobs", "title", "score", "blocked") == [("A", 7, False), ("B", 1, False), ("CTO", 1, True), ("R", 5, False)]
    assert store.read("jobs").agg(F.max(F.length("description"))).first()[0] == 2000
    assert table(store, "outbox", "seq", "score") == [(1, 5), (2, 7)]
    got = {(r.token, r.reason) for r in store.read("quarantine").collect()}
    assert got == {
        (None, "unparseable_body"),
        ("gone", "not_found"),
        ("odd", "unsupported_kind"),
    }

    before = {t: store.read(t).count() for t in ("jobs", "outbox", "deliveries", "runs", "quarantine", "staged")}
    again = run_batch(store, first_batch(spark), config, "b1", T1)
    assert again == one
    assert {t: store.read(t).count() for t in before} == before

    second = payload_frame(spark, payload("lever", board(("A", "juce"), ("N", "juce audio dsp")), "acme"))
    two = run_batch(store, second, config, "b2", T2)
    assert (two.jobs_found, two.jobs_new, two.jobs_alerted) == (2, 1, 1)
    assert ("A", 7) in table(store, "jobs", "title", "score")  # a stored row is never rescored
    assert table(store, "runs", "run_id", "jobs_new") == [("b1", 4), ("b2", 1)]
    assert store.read("summaries").count() == 2


def test_modes_and_failed_deliveries(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    dry = run_batch(store, first_batch(spark), config, "b1", T1, mode="dry")
    assert dry.jobs_alerted == 2 and store.read("jobs").count() == 4 and store.read("deliveries").count() == 0
    empty = payload_frame(spark, payload("wwr", rss("")))
    summary = run_batch(store, empty, config, "b2", T1, mode="summary")
    assert summary.jobs_alerted == 0 and store.read("runs").count() == 2
    half = run_batch(
        store, empty, config, "b3", T1, deliver=lambda o: o.select("job_id", (F.col("score") > 5).alias("ok"))
    )
    assert half.jobs_alerted == 1
    rest = run_batch(store, empty, config, "b4", T2)
    assert rest.jobs_alerted == 1  # the failed one came back
    with pytest.raises(ValueError):
        run_batch(store, empty, config, "b5", T2, mode="other")


def test_attempted_deliveries_leave_the_queue(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    lossy = RunConfig(config.lexicon, config.roster, config.blocklist, mark="attempted", drop_blocked=True)
    fail = lambda o: o.select("job_id", F.lit(False).alias("ok"))
    one = run_batch(store, first_batch(spark), lossy, "b1", T1, deliver=fail)
    assert one.jobs_alerted == 0 and one.jobs_new == 3
    assert run_batch(store, first_batch(spark), lossy, "b2", T2).jobs_alerted == 0


def test_boards_only_and_caller_errors(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    result = run_batch(store, first_batch(spark), config, "b1", T1, boards_only=True, errors=["fetch failed"])
    assert (result.jobs_found, result.jobs_new) == (4, 3)
    assert result.errors == ["fetch failed", "roster failed: unsupported_kind (1)"]
    assert store.read("runs").first().errors == result.errors


def test_bootstrap_is_repeatable(spark, tmp_path):
    store = ListingStore(spark, str(tmp_path))
    assert store.read("jobs").count() == 0
    store.bootstrap()
    store.bootstrap()
    assert store.read("jobs").count() == 0


def counts(store):
    return {t: store.read(t).count() for t in ("staged", "jobs", "quarantine", "deliveries", "runs", "outbox", "summaries")}


def test_replay_after_a_later_run_changes_nothing(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    sent = []

    def deliver(rows):
        sent.append(sorted(r.title_key for r in rows.select(F.col("job_key").alias("title_key")).collect()))
        return rows.select("job_id", F.lit(True).alias("ok"))

    one = run_batch(store, first_batch(spark), config, "b1", T1, deliver=deliver)
    later = payload_frame(spark, payload("lever", board(("N", "juce")), "acme"))
    run_batch(store, later, config, "b2", T2, mode="summary")
    before, outbox = counts(store), table(store, "outbox", "run_id", "seq", "job_key", "payload")
    again = run_batch(store, first_batch(spark), config, "b1", T2, deliver=deliver)
    assert again == one and counts(store) == before
    assert table(store, "outbox", "run_id", "seq", "job_key", "payload") == outbox
    assert len(sent[0]) == 2 and sent[1] == []
    seen = {r.seen_at for r in store.read("jobs").filter("batch_id = 'b1'").collect()}
    assert len(seen) == 1 and store.clock("b1", T2) == T1.replace(tzinfo=T1.tzinfo or timezone.utc)


def test_failed_deliveries_are_tried_again_by_the_same_run(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    fail = lambda o: o.select("job_key", F.lit(False).alias("ok"))
    for _ in range(2):
        assert run_batch(store, first_batch(spark), config, "b1", T1, deliver=fail).jobs_alerted == 0
    half = lambda o: o.select("job_id", (F.col("score") > 5).alias("ok"))
    assert run_batch(store, first_batch(spark), config, "b1", T1, deliver=half).jobs_alerted == 1
    assert run_batch(store, first_batch(spark), config, "b1", T1).jobs_alerted == 2
    assert store.read("deliveries").count() == 2


def test_an_empty_rerun_clears_its_partitions(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    run_batch(store, first_batch(spark), config, "b1", T1, mode="summary")
    empty = payload_frame(spark, payload("lever", [], "acme"))
    result = run_batch(store, empty, config, "b1", T1, mode="summary")
    assert (result.jobs_found, result.jobs_new) == (0, 0)
    assert store.read("jobs").count() == store.read("staged").count() == 0
    assert {(r.ats, r.token) for r in store.read("zero_yield").collect()} == {("lever", "acme"), ("ashby", "gone")}


def test_dry_rows_are_marked(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    run_batch(store, first_batch(spark), config, "b1", T1, mode="dry")
    assert {r.mode for r in store.read("outbox").collect()} == {r.mode for r in store.read("summaries").collect()} == {"dry"}
    assert run_batch(store, first_batch(spark), config, "b1", T1).jobs_alerted == 2
    assert {r.mode for r in store.read("outbox").collect()} == {"live"}


def test_listings_that_share_a_printed_id_stay_apart(spark, tmp_path, config, monkeypatch):
    from postsieve.operators import dedup

    monkeypatch.setattr(dedup, "ID_DIGITS", 0)  # every listing gets the same printed id
    store = ListingStore(spark, str(tmp_path))
    result = run_batch(store, first_batch(spark), config, "b1", T1)
    assert (result.jobs_new, result.jobs_alerted) == (4, 2)
    assert {r.job_id for r in store.read("jobs").collect()} == {""}
    assert run_batch(store, first_batch(spark), config, "b2", T2).jobs_new == 0


def test_descriptions_do_not_move_before_known_keys_are_out(spark, config):
    rows = listing_frame(spark, *[listing(f"t{i}", url=str(i), description="x" * 50) for i in range(20)])
    stored = spark.createDataFrame([("k",)], "job_key string")
    keyed = new_listings(rows, stored, config, None)
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    anti = plan[plan.index("LeftAnti") :]
    assert "Exchange" in anti and not any("description" in line for line in anti.splitlines() if "Exchange" in line)


def test_quarantine_can_be_traced(spark, tmp_path, config):
    store = ListingStore(spark, str(tmp_path))
    odd = payload_frame(spark, payload("wwr", "garbage", endpoint_ord=3), payload("lever", '[{"text": ', "acme")).withColumn("endpoint", F.concat(F.lit("https://x/"), "source_kind"))
    run_batch(store, odd, config, "b1", T1)
    got = {(r.source_kind, r.endpoint, r.endpoint_ord, r.reason, r.raw) for r in store.read("quarantine").filter("reason = 'unparseable_body'").collect()}
    assert got == {("wwr", "https://x/wwr", 3, "unparseable_body", "garbage"), ("lever", "https://x/lever", 0, "unparseable_body", '[{"text": ')}


def test_known_listings_are_neither_scored_nor_moved(spark):
    """Few first sightings are brought to the wide rows before these are scored; many meet
    them in a shuffle. Both give the same rows."""
    rows = [listing(f"t{i % 7}", url=f"u{i % 7}", description="juce", pos=i) for i in range(40)]
    stored = with_key(listing_frame(spark, listing("t0", url="u0"))).select("job_key")
    config = RunConfig(lexicon_frame(spark, {"juce": 6}), roster_frame(spark, []), [])
    few = new_listings(listing_frame(spark, *rows), stored, config)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("juce") < plan.index("LeftSemi")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(polling, "BROADCAST_MAX_KEY_BYTES", 0)
        many = new_listings(listing_frame(spark, *rows), stored, config)
    result = lambda df: sorted((r.title, r.src_pos, r.score) for r in df.collect())
    assert result(few) == result(many) == [(f"t{i}", i, 6) for i in range(1, 7)]


def test_the_outbox_sorts_rows_and_not_their_bodies(spark, tmp_path):
    """Bodies are made above the sort, in tasks of a bounded number of alerts."""
    store = ListingStore(spark, str(tmp_path / "store"))
    items = [{"text": f"t{i}", "hostedUrl": f"u{i}", "descriptionPlain": "juce " + "x" * 400} for i in range(40)]
    config = RunConfig(lexicon_frame(spark, {"juce": 6}), roster_frame(spark, [("Acme", "lever", "acme")]), [])
    plans, replace = [], store.replace

    def kept(table, part, rows):
        if table == "outbox":
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return replace(table, part, rows)

    store.replace = kept
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(polling, "OUTBOX_ROWS", 3, raising=False)
        run_batch(store, payload_frame(spark, payload("lever", items, "acme")), config, "b1")
    assert plans[0].index("embeds") < plans[0].index("Sort [seq") and "RepartitionByExpression [job_key" in plans[0]
    rows = store.read("outbox").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 41)) and len({r.job_id for r in rows}) == 40
    shown = [json.loads(r.payload)["embeds"][0]["fields"][5]["value"] for r in rows]
    assert {(len(s), s[-1]) for s in shown} == {(301, "…")}
