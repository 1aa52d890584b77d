import hashlib
import unicodedata

from pyspark.sql import functions as F

from postsieve import functions as fn


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_strip_html(spark):
    cases = {
        "a <b\nc> x": "a   x",
        "<p>t &amp; s</p>": "t &amp; s",
        None: "",
        "<script>var a;</script>b": "var a; b",
        "1 < 2 <> 3": "1   3",
        "  x <br/>\x1c": "x",
    }
    assert one(spark, fn.strip_html("c"), *cases) == list(cases.values())


def test_strip_space_equals_python_on_every_whitespace_character(spark):
    points = [chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) != "Cs"]
    texts = [f"{p}a{p} b{p}{p}" for p in points]
    assert one(spark, fn.strip_space("c"), *texts) == [t.strip() for t in texts]
    assert one(spark, fn.strip_space("c"), "a\n", "\n", " ", "", "a\r\n\u0085") == ["a", "", "", "", "a"]


def test_truncate_and_snippet_count_code_points(spark):
    emoji = "😀" * 301
    assert one(spark, fn.truncate("c", 2000), "é" * 2001, emoji) == ["é" * 2000, emoji]
    assert one(spark, fn.snippet("c"), emoji, "x" * 300, None) == ["😀" * 300 + "…", "x" * 300, ""]


def test_split_title(spark):
    company, title = fn.split_title(F.col("c"))
    texts = ["Acme: Dev: Sr", "Acme: ", ": Dev", "none", " Acme : x ", "a:b"]
    assert one(spark, company, *texts) == ["Acme", "Acme", "", "Unknown", "Acme", "Unknown"]
    assert one(spark, title, *texts) == ["Dev: Sr", "", "Dev", "none", "x ", "a:b"]


def test_search_text_keeps_empty_parts(spark):
    df = spark.createDataFrame([("A", "", "C"), ("A", None, None)], "t string, d string, c string")
    got = [r.x for r in df.select(fn.search_text("t", "d", "c").alias("x")).collect()]
    assert got == ["a  c", "a  "]


def test_listing_key(spark):
    rows = [("Ünï Dev", "ACME", "https://X/Y"), ("ünï dev", "acme", "https://X/Y"), ("ünï dev", "acme", "https://x/y"), ("a", None, "u")]
    df = spark.createDataFrame(rows, "title string, company string, url string")
    got = [r.x for r in df.select(fn.listing_key().alias("x")).collect()]
    want = [
        hashlib.sha1(f"{t.lower()}|{(c or '').lower()}|{u}".encode()).hexdigest()[:16] for t, c, u in rows
    ]
    assert got == want and got[0] == got[1] != got[2]


def test_defaults_and_lists(spark):
    assert one(spark, fn.or_default("c", "d"), None, "", " ", "x") == ["d", "d", " ", "x"]
    assert one(spark, fn.render_list(F.split("c", "\\|")), "a|b", "a") == ["a, b", "a"]
    assert one(spark, fn.render_list(F.split("c", "\\|"), "\n", 2), "a|b|c") == ["a\nb"]
    assert one(spark, fn.posting_url(F.lit("t"), "c"), "7") == ["https://jobs.ashbyhq.com/t/7"]


def test_tiers(spark):
    df = spark.createDataFrame([(s,) for s in (-1, 0, 1, 5, 10, 19, 20)], "score int")
    rows = df.orderBy("score").select(fn.tier_label().alias("l"), fn.tier_colour().alias("c")).collect()
    labels = ["Target Company"] * 3 + ["Good Match", "Strong Match", "Strong Match", "Excellent Match"]
    assert [r.l for r in rows] == labels
    assert [r.c for r in rows] == [9807270] * 3 + [3447003, 16753920, 16753920, 65280]


def test_embedded_json_and_counts(spark):
    page = '<script>window.__appData =\n {"jobBoard":{"jobPostings":[{},{}]}};</script>'
    assert one(spark, fn.embedded_json("c"), page, "x", None) == ['{"jobBoard":{"jobPostings":[{},{}]}}', None, None]
    count = fn.json_count(fn.embedded_json("c"), "$.jobBoard.jobPostings")
    assert one(spark, count, page, "window.__appData = {};", None) == [2, 0, 0]
    assert one(spark, fn.json_count("c"), "[1,2]", "{}", "x", "[]") == [2, 0, 0, 0]


def test_iso_utc(spark):
    df = spark.sql("select timestamp'2026-01-02 03:04:05' a, timestamp'2026-01-02 03:04:05.000600' b")
    row = df.select(fn.iso_utc("a").alias("a"), fn.iso_utc("b").alias("b")).first()
    assert (row.a, row.b) == ("2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.000600+00:00")
