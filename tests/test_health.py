from pyspark.sql import functions as F

from helpers import payload, payload_frame
from postsieve.plans import audit
from postsieve.sources import roster_frame

PAGE = '<script>window.__appData = {"jobBoard":{"jobPostings":[{},{}]}};</script>'


def test_audit(spark):
    entries = [
        ("G ok", "greenhouse", "g1", payload("greenhouse", {"jobs": [{}, {}, {}]}, "g1")),
        ("G empty", "greenhouse", "g2", payload("greenhouse", {"jobs": []}, "g2")),
        ("G gone", "greenhouse", "g3", payload("greenhouse", None, "g3", status=404)),
        ("G cut", "greenhouse", "g4", payload("greenhouse", '{"jobs":[{}', "g4")),
        ("L ok", "lever", "l1", payload("lever", [{}], "l1")),
        ("L object", "lever", "l2", payload("lever", {"ok": False}, "l2")),
        ("L down", "lever", "l3", payload("lever", None, "l3", status=None, error="timed out " * 10)),
        ("A ok", "ashby", "a1", payload("ashby", PAGE, "a1")),
        ("A none", "ashby", "a2", payload("ashby", "<html></html>", "a2")),
        ("A cut", "ashby", "a3", payload("ashby", 'window.__appData = {"a":"};"};', "a3")),
        ("A gone", "ashby", "a4", payload("ashby", None, "a4", status=500)),
        ("Silent", "lever", "l9", None),
        ("G ok again", "greenhouse", "g1", None),
        ("Odd", "workday", "w", None),
    ]
    roster = roster_frame(spark, [e[:3] for e in entries])
    report = audit(roster, payload_frame(spark, *[e[3] for e in entries if e[3]]))
    got = [(r.name, r.status, r.detail) for r in report.endpoints.orderBy("ord").collect()]
    assert got == [
        ("G ok", "OK", "3"),
        ("G empty", "EMPTY", "0"),
        ("G gone", "HTTP_ERR", "404"),
        ("G cut", "ERR", "invalid JSON"),
        ("L ok", "OK", "1"),
        ("L object", "EMPTY", "0"),
        ("L down", "ERR", ("timed out " * 10)[:60]),
        ("A ok", "OK", "2"),
        ("A none", "EMPTY", "0"),
        ("A cut", "ERR", "invalid JSON"),
        ("A gone", "HTTP_ERR", "500"),
        ("Silent", "ERR", "no response"),
        ("G ok again", "OK", "3"),
    ]
    assert {r.bucket: r.endpoints for r in report.tally.collect()} == {"ok": 4, "empty": 3, "broken": 6}
    assert [(r.name, r.suggested_url) for r in report.repairs.orderBy("ord").collect()] == [
        ("G gone", "https://boards.greenhouse.io/g3"),
        ("G cut", "https://boards.greenhouse.io/g4"),
        ("L down", "https://jobs.lever.co/l3"),
        ("A cut", "https://jobs.ashbyhq.com/a3"),
        ("A gone", "https://jobs.ashbyhq.com/a4"),
        ("Silent", "https://jobs.lever.co/l9"),
    ]
    assert [r.token for r in report.unsupported.collect()] == ["w"]


def test_the_newest_response_of_an_endpoint_counts(spark):
    roster = roster_frame(spark, [("Acme", "lever", "acme"), ("Again", "lever", "acme"), ("None", "ashby", "x")])
    rows = payload_frame(spark, payload("lever", [{"text": "a"}], "acme"), payload("lever", [], "acme"), payload("lever", None, "acme", status=500))
    hours = F.when(F.col("status_code") == 500, 1).when(F.col("body") == "[]", 3).otherwise(2)
    landed = rows.withColumn("fetched_at", F.timestamp_seconds(hours * 3600))
    got = [(r.name, r.status, r.detail) for r in audit(roster, landed).endpoints.orderBy("ord").collect()]
    assert got == [("Acme", "EMPTY", "0"), ("Again", "EMPTY", "0"), ("None", "ERR", "no response")]


def test_bodies_are_in_no_exchange(spark, tmp_path):
    payload_frame(spark, payload("lever", [], "acme")).write.parquet(str(tmp_path / "landed"))
    roster = roster_frame(spark, [("Acme", "lever", "acme")])
    plan = audit(roster, spark.read.parquet(str(tmp_path / "landed"))).endpoints._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "body" not in plan[join : plan.index("Aggregate")] and "Aggregate" in plan[join:]
