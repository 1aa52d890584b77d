"""Headline timings, one JSON line. Every query is run in full into a no-op sink.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores, BENCH_ONLY optionally a comma-separated choice of queries.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from catalog import views as v
from catalog.queries import QUERIES
from postsieve import defaults
from postsieve.operators.scoring import lexicon_frame, score_listings

RUNS = 2


def lexicon_of(spark, sf, size):
    """Scoring of all documents against ``size`` phrases (template phrases first)."""
    weights = {**v.PHRASES, **defaults.KEYWORD_WEIGHTS}
    for i in range(size):
        weights[f"zq{i} audio engineer"] = 1
    chosen = dict(list(weights.items())[:size])
    return score_listings(v.listings(spark, sf), lexicon_frame(spark, chosen), defaults.TITLE_BLOCKLIST, key="doc_id")


HEADLINE = {
    **{
        name: QUERIES[name]
        for name in (
            "strip_html",
            "job_key",
            "dedup_first_wins",
            "score_phrases",
            "score_long_lexicon",
            "score_target_floor",
            "pending_alerts",
            "new_only",
            "board_roundtrip_greenhouse",
            "board_roundtrip_lever",
            "feed_remoteok",
            "feed_title_split",
            "source_union_counts",
            "roster_routing",
            "zero_yield",
            "health_audit",
            "alert_payload",
            "stored_listings",
            "stream_first_seen",
        )
    },
    "score_32_phrases": lambda spark, sf: lexicon_of(spark, sf, 32),
    "score_1000_phrases": lambda spark, sf: lexicon_of(spark, sf, 1000),
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in HEADLINE.items():
        if only and name not in only:
            continue
        spent = []
        while len(spent) < (2 if spent and spent[0] > 15 else RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
