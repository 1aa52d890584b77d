import json

import pytest
from pyspark.sql import functions as F

from helpers import payload, payload_frame, rss
from postsieve.schemas import STAGED
from postsieve.sources import (
    Source,
    default_registry,
    first_endpoints,
    normalise,
    roster_frame,
    unsupported,
    zero_yield,
)
from postsieve.sources import feeds
from postsieve.operators.counts import error_list, error_messages, source_counts

FIELDS = ["title", "company", "location", "url", "source", "description"]


def run(spark, kind, body, **kw):
    roster = roster_frame(spark, [("Acme", kind, "acme")])
    out = normalise(payload_frame(spark, payload(kind, body, token="acme", **kw)), roster, kinds=[kind])
    return out.orderBy("src_pos").collect()


def good(rows):
    return [tuple(r[f] for f in FIELDS) for r in rows if r.reason is None]


def reasons(rows):
    return [r.reason for r in rows if r.reason]


def test_greenhouse(spark):
    body = {
        "jobs": [
            {"title": "A", "absolute_url": "u1", "location": {"name": "X"}, "content": "<p>t &amp; s</p>"},
            {"title": "", "absolute_url": "u2"},
            {"title": "B", "absolute_url": None},
            {"title": " ", "absolute_url": "u3"},
            {"title": "D", "absolute_url": "u4", "location": None, "content": None},
            "scalar",
        ]
    }
    rows = run(spark, "greenhouse", body)
    assert good(rows) == [
        ("A", "Acme", "X", "u1", "Greenhouse/acme", "t &amp; s"),
        (" ", "Acme", "", "u3", "Greenhouse/acme", ""),
        ("D", "Acme", "", "u4", "Greenhouse/acme", ""),
    ]
    assert reasons(rows) == ["bad_record"]
    assert [r.src_pos for r in rows if r.reason is None] == [0, 3, 4]
    assert rows[0].src_rank == 3 and rows[0].endpoint_ord == 0


@pytest.mark.parametrize("body", [{}, {"jobs": []}, {"jobs": None}])
def test_greenhouse_empty_board(spark, body):
    assert run(spark, "greenhouse", body) == []


@pytest.mark.parametrize("body", ["", "nonsense", '{"jobs":[{"title":"A"', None])
def test_unreadable_body_is_quarantined(spark, body):
    for kind in ("greenhouse", "lever", "ashby"):
        assert reasons(run(spark, kind, body)) == ["unparseable_body"]


def test_lever(spark):
    body = [
        {
            "text": "A",
            "hostedUrl": "u1",
            "categories": {"location": "X"},
            "descriptionPlain": " d",
            "lists": [{"content": "<li>r</li>"}, {"content": "q "}],
        },
        {"text": "B", "hostedUrl": "u2"},
        7,
    ]
    rows = run(spark, "lever", body)
    assert good(rows) == [
        ("A", "Acme", "X", "u1", "Lever/acme", "d r q"),
        ("B", "Acme", "", "u2", "Lever/acme", ""),
    ]
    assert reasons(rows) == ["bad_record"]
    assert reasons(run(spark, "lever", {"ok": False})) == ["unparseable_body"]


def test_ashby(spark):
    body = {
        "data": {
            "jobBoard": {
                "jobPostings": [
                    {"id": "1", "title": "A", "locationName": "", "workplaceType": "Remote"},
                    {"id": "2", "title": "B", "locationName": None, "workplaceType": "Remote"},
                    {"id": "3", "title": "C", "locationName": "Oslo", "workplaceType": "Remote"},
                    {"id": "4", "title": "D", "locationName": "", "workplaceType": "OnSite"},
                    {"id": "", "title": "E"},
                    {"id": "6", "title": None},
                ]
            }
        }
    }
    url = "https://jobs.ashbyhq.com/acme/"
    assert good(run(spark, "ashby", body)) == [
        ("A", "Acme", "Remote", url + "1", "Ashby/acme", ""),
        ("B", "Acme", "Remote", url + "2", "Ashby/acme", ""),
        ("C", "Acme", "Oslo", url + "3", "Ashby/acme", ""),
        ("D", "Acme", "", url + "4", "Ashby/acme", ""),
    ]
    assert run(spark, "ashby", {"data": {"jobBoard": None}}) == []
    assert run(spark, "ashby", {"data": {"jobBoard": {"jobPostings": None}}}) == []


def test_status_routing(spark):
    assert reasons(run(spark, "greenhouse", "x", status=404)) == ["not_found"]
    assert reasons(run(spark, "greenhouse", "x", status=403)) == ["http_error"]
    assert reasons(run(spark, "lever", "x", status=500)) == ["http_error"]
    assert reasons(run(spark, "lever", None, status=None, error="timed out")) == ["http_error"]
    for status in (401, 403, 404):
        assert reasons(run(spark, "ashby", "x", status=status)) == ["not_found"]
    rows = run(spark, "lever", None, status=503)
    assert rows[0].detail == "503"


def test_remoteok(spark):
    body = [
        {"legal": "x"},
        {"position": "A", "company": "C", "url": "u1", "location": "", "description": "<b>d</b>"},
        "skip me",
        {"position": "B", "company": None, "url": "u2"},
        {"position": "E", "company": "C", "url": ""},
    ]
    rows = run(spark, "remoteok", body)
    assert good(rows) == [
        ("A", "C", "Remote", "u1", "RemoteOK", "d"),
        ("B", "", "Remote", "u2", "RemoteOK", ""),
    ]
    assert reasons(rows) == []
    assert [r.src_pos for r in rows] == [1, 3]


def test_wwr(spark):
    body = rss(
        "<item><title>Acme: Dev: Sr</title><link>u1</link><description><![CDATA[<p>d</p>]]></description></item>"
        "<item><title>Acme: </title><link>u2</link></item>"
        "<item><title>: Dev</title><link>u3</link></item>"
        "<item><title>No separator</title><link>u4</link></item>"
        "<item><title>Acme: NoLink</title></item>"
    )
    assert good(run(spark, "wwr", body)) == [
        ("Dev: Sr", "Acme", "Remote", "u1", "WeWorkRemotely", "d"),
        # The reader trims element text, as feed libraries do: 'Acme:' has no separator left.
        ("Acme:", "Unknown", "Remote", "u2", "WeWorkRemotely", ""),
        (": Dev"[2:], "", "Remote", "u3", "WeWorkRemotely", ""),
        ("No separator", "Unknown", "Remote", "u4", "WeWorkRemotely", ""),
    ]


def test_avixa(spark):
    long = "x" * 2500
    body = rss(
        "<item><title> A </title><link> u1 </link><author> Ann </author><category>t</category></item>"
        "<item><title>B</title><link>u2</link><category/><category>Tag</category><category>Z</category></item>"
        f"<item><title>C</title><link>u3</link><description>{long}</description><location>L</location></item>"
        "<item><title>D</title><link>u4</link><summary>s</summary><description>d</description></item>"
        "<item><title>   </title><link>u5</link></item>"
    )
    assert good(run(spark, "avixa", body)) == [
        ("A", "Ann", "", "u1", "AVIXA", ""),
        ("B", "Tag", "", "u2", "AVIXA", ""),
        ("C", "AVIXA Board", "L", "u3", "AVIXA", "x" * 2000),
        ("D", "AVIXA Board", "", "u4", "AVIXA", "s"),
    ]


def test_broken_feed_keeps_whole_items(spark):
    body = rss("<item><title>Acme: One</title><link>u1</link></item><item><title>Acme: Tw")[:-30]
    assert [g[0] for g in good(run(spark, "wwr", body))] == ["One"]
    assert reasons(run(spark, "wwr", "not a feed")) == ["unparseable_body"]
    assert run(spark, "wwr", rss("")) == []


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        rss("".join(f"<item><title>Co: Job {i}</title><link>u{i}</link></item>" for i in range(5)))
    )
    items = feeds.from_files(feeds.read_items(spark, str(tmp_path)), "wwr", 1)
    rows = feeds.wwr_items(items).orderBy("src_pos").collect()
    assert [(r.company, r.title, r.url) for r in rows] == [("Co", f"Job {i}", f"u{i}") for i in range(5)]


def test_union_order_and_selection(spark):
    roster = roster_frame(spark, [("Acme", "lever", "acme"), ("Again", "lever", "acme"), ("Odd", "workday", "odd")])
    payloads = payload_frame(
        spark,
        payload("lever", [{"text": "L", "hostedUrl": "u"}], token="acme"),
        payload("lever", [{"text": "stray", "hostedUrl": "u"}], token="unlisted"),
        payload("remoteok", [{}, {"position": "R", "url": "u"}]),
        payload("wwr", rss("<item><title>W</title><link>u</link></item>"), endpoint_ord=1),
        payload("wwr", rss("<item><title>V</title><link>u</link></item>"), endpoint_ord=0),
        payload("avixa", rss("<item><title>X</title><link>u</link></item>")),
    )
    order = ["src_rank", "endpoint_ord", "src_pos"]
    assert [r.title for r in normalise(payloads, roster).orderBy(*order).collect()] == ["R", "V", "W", "X", "L"]
    only = normalise(payloads, roster, boards_only=True).collect()
    assert [(r.title, r.company) for r in only] == [("L", "Acme")]
    counts = {(r.source_kind, r.endpoint_ord, r.level): r.listings for r in source_counts(normalise(payloads, roster)).collect()}
    assert counts[(None, None, 0)] == 5 and counts[("wwr", None, 1)] == 2 and counts[("wwr", 1, 2)] == 1


def test_registry_accepts_new_sources_and_checks_their_schema(spark):
    def mine(payloads):
        return payloads.select(
            *[
                (F.col("body") if f.name in ("title", "url") else F.col(f.name) if f.name in payloads.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in STAGED.fields
            ]
        )

    roster = roster_frame(spark, [("Acme", "lever", "acme")])
    registry = default_registry().register(Source("plain", mine, 9))
    rows = normalise(payload_frame(spark, payload("plain", "T")), roster, registry, kinds=["plain"]).collect()
    assert [(r.title, r.src_rank) for r in rows] == [("T", 9)]
    broken = default_registry().register(Source("plain", lambda p: p.select("body"), 9))
    with pytest.raises(TypeError):
        normalise(payload_frame(spark, payload("plain", "T")), roster, broken, kinds=["plain"])


def test_roster_reports(spark):
    roster = roster_frame(
        spark, [("First", "lever", "t"), ("Second", "lever", "t"), ("Other", "ashby", "t"), ("Odd", "workday", "w")]
    )
    assert [r.name for r in first_endpoints(roster).orderBy("ord").collect()] == ["First", "Other", "Odd"]
    assert [(r.token, r.detail) for r in unsupported(roster, ["lever", "ashby"]).collect()] == [("w", "Odd")]
    listings = spark.createDataFrame([("lever", "t")] * 3, "source_kind string, token string")
    labels = [r.label for r in zero_yield(roster, listings).orderBy("ord").collect()]
    assert labels == ["Other (ashby/t)", "Odd (workday/w)"]


def test_error_messages(spark):
    rows = [("lever", "a", "http_error", "500", None)] * 3 + [
        ("lever", "b", "not_found", "404", None),
        ("odd", "c", "unsupported_kind", "x", None),
        ("even", "c", "unsupported_kind", "x", None),
    ]
    q = spark.createDataFrame(rows, "source_kind string, token string, reason string, detail string, raw string")
    assert error_list(error_messages(q)).first().errors == [
        "lever failed: http_error (3)",
        "roster failed: unsupported_kind (2)",
    ]
    assert error_list(error_messages(q.limit(0))).first().errors == []
