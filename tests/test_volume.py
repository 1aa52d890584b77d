"""How often texts are parsed and moved, as the plans say."""

from catalog import views as v
from helpers import listing, listing_frame, payload, payload_frame
from postsieve.operators.scoring import lexicon_frame
from postsieve.plans import RunConfig, new_listings
from postsieve.sources import default_registry, roster_frame

SF = "/root/testdata/sf0.001"


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_a_body_and_a_record_are_parsed_once(spark):
    rows = payload_frame(spark, payload("greenhouse", {"jobs": [{"title": "t", "absolute_url": "u"}]}, "acme")).repartition(2)
    roster = roster_frame(spark, [("Acme", "greenhouse", "acme")])
    plan = plan_of(default_registry().apply("greenhouse", rows, roster), "optimizedPlan")
    assert plan.count("from_json(") == 2


def test_descriptions_of_a_batch_move_once_and_no_longer_than_stored(spark):
    rows = listing_frame(spark, *[listing(f"t{i % 3}", description="juce " + "x" * 50 + str(i), pos=i) for i in range(9)]).repartition(3)
    config = RunConfig(lexicon_frame(spark, {"juce": 6}), roster_frame(spark, [("Acme", "lever", "acme")]), ["cto"], description_chars=7)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = new_listings(rows, spark.createDataFrame([], "job_key string"), config, None)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = sorted((r.title, r.score, r.description) for r in out.collect())
        shuffles = plan_of(out).count("Exchange hashpartitioning(_place")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert got == [(f"t{i}", 6, "juce xx") for i in range(3)]
    assert shuffles == 2 and "left(description" in plan or "substring(description" in plan


def test_documents_are_brought_together_once_for_all_boards(spark):
    plan = plan_of(v.board_payloads(spark, SF, *v.BOARDS))
    assert plan.count("Exchange") == 1


def test_a_shuffled_lexicon_meets_only_what_may_be_its_keys(spark):
    from dataclasses import replace

    from postsieve.operators import scoring

    texts = [(1, "red fox and a red fox in red"), (2, "the blue fox ran -- off"), (3, ""), (4, "fox")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    phrases = {"red fox": 1, "a red fox in": 2, "fox": 3, " -- ": 4, "in red sea": 5}
    lexicon = replace(scoring.Lexicon.of(lexicon_frame(spark, phrases), scan_max=0), fits_broadcast=False)
    held = scoring._held(rows, "doc_id", lexicon).distinct().collect()
    keys = {r.gram for r in lexicon.table.collect()}
    want = {(r.doc_id, r.gram) for r in scoring.text_grams(rows, "doc_id", lexicon.sizes).collect() if r.gram in keys}
    assert {tuple(r) for r in held} == want and len(want) == 6
    found = {r.doc_id: {c.phrase for c in r.candidates} for r in scoring.candidates(rows, "doc_id", lexicon).collect()}
    assert found == {1: {"red fox", "a red fox in", "fox"}, 2: {"fox", " -- "}, 4: {"fox"}}


def test_many_keys_are_not_sent_through_the_driver(spark):
    from postsieve.operators.dedup import new_only

    keys = lambda lo, hi: spark.range(lo, hi).selectExpr("sha1(cast(id as string)) as job_key")
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many, few = (new_only(keys(0, 100), keys(50, 200), rows) for rows in (500_000, 100_000))
        assert "BroadcastHashJoin" not in plan_of(many) and "BroadcastHashJoin" in plan_of(few)
        assert many.count() == few.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_digests_of_small_files_are_not_sent_through_the_driver(spark, tmp_path):
    """By the size of its files a table of digests may be small, however many it holds."""
    from postsieve.operators.dedup import new_only, without_packed
    from postsieve.operators.queue import number_rows, pending

    path = str(tmp_path / "keys")
    spark.range(500).selectExpr("sha1(cast(id as string)) as job_key", "int(id % 9) as score", "timestamp_seconds(id % 2) as seen_at").write.parquet(path)
    keys = spark.read.parquet(path)
    wanted = keys.filter("score >= 3")
    plans = [
        plan_of(new_only(keys, wanted, 500_000)),
        plan_of(without_packed(keys, [wanted.select("job_key")])),
        plan_of(pending(keys, wanted)),
    ]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    numbered = number_rows(wanted)
    first = next(line for line in plan_of(numbered).splitlines() if "Join" in line)
    assert "SortMergeJoin" in first
    assert sorted(r.seq for r in numbered.collect()) == list(range(1, wanted.count() + 1))
