"""Registered queries over small tables of their own, where the test tables show too little."""

import duckdb
import pytest
from pyspark.sql import functions as F

from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from check import canonical
from helpers import payload, payload_frame
from postsieve.sources import default_registry


def test_zero_yield_reads_every_order(spark, tmp_path):
    customers = [(1, "urgent", "BUILDING"), (2, "old and low", "BUILDING"), (3, "none", "FURNITURE")]
    orders = [(1, "1-URGENT", "2001-01-01 00:00:00"), (2, "5-LOW", "1995-01-01 00:00:00")]
    written = {
        "customer": spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string"),
        "orders": spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_orderdate string").selectExpr(
            "o_custkey", "o_orderpriority", "cast(o_orderdate as timestamp_ntz) as o_orderdate"
        ),
    }
    duck = duckdb.connect()
    for name, rows in written.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["zero_yield"](spark, str(tmp_path)).toPandas()
    assert got.ord.tolist() == [3] and canonical(got) == canonical(duck.execute(ORACLES["zero_yield"]).df())


@pytest.fixture(scope="module")
def with_empty_texts(tmp_path_factory):
    """Some documents of the smallest tables, and three without text."""
    folder, source = str(tmp_path_factory.mktemp("empty")), "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT * FROM '{source}/documents.parquet' WHERE doc_id < 20
        UNION ALL SELECT 1000 + i, '', 'fr', 'src' || i, i FROM range(3) t(i)) TO '{folder}/documents.parquet' (FORMAT parquet)""")
    for table in ("part", "customer"):
        duck.execute(f"COPY (FROM '{source}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    for table in ("documents", "part", "customer"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return folder, duck


@pytest.mark.parametrize(
    "name",
    [
        "board_roundtrip_ashby", "board_roundtrip_greenhouse", "board_roundtrip_lever", "feed_remoteok",
        "run_source_counts", "source_union_counts", "source_union_subset", "stream_first_seen",
    ],
)
def test_documents_without_text_are_listings(spark, with_empty_texts, name):
    folder, duck = with_empty_texts
    assert canonical(QUERIES[name](spark, folder).toPandas()) == canonical(duck.execute(ORACLES[name]).df())


def test_a_board_lists_an_untitled_posting_only_where_asked(spark):
    rows = payload_frame(spark, payload("remoteok", [{}, {"position": "", "url": "u1"}, {"url": "u2"}, {"position": "t"}, {"position": "t", "url": "u4"}]))
    urls = lambda registry: [r.url for r in registry.apply("remoteok", rows).orderBy("src_pos").collect()]
    assert urls(default_registry()) == ["u4"] and urls(default_registry(untitled=True)) == ["u1", "u2", "u4"]


@pytest.mark.parametrize("kind,head,field,tail", [
    ("remoteok", '[{},', '"url":"u","position"', "]"),
    ("greenhouse", '{"jobs":[', '"absolute_url":"u","title"', "]}"),
    ("lever", "[", '"hostedUrl":"u","text"', "]"),
    ("ashby", '{"data":{"jobBoard":{"jobPostings":[', '"id":"u","title"', "]}}}"),
])
def test_a_long_text_does_not_make_its_board_unreadable(spark, kind, head, field, tail):
    """The JSON reader by itself takes texts of up to 20 million characters."""
    body = F.expr(f"concat('{head}', '{{{field}:\"', repeat('x', 20100000), '\"}}', ',{{{field}:\"next\"}}', '{tail}')")
    rows = default_registry().apply(kind, payload_frame(spark, payload(kind, "", "acme")).withColumn("body", body))
    got = rows.orderBy("src_pos").select("reason", F.length("title").alias("n")).collect()
    assert [tuple(r) for r in got] == [(None, 20_100_000), (None, 4)]
