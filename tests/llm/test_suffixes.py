"""Repeated byte strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postsieve.llm import suffixes
from postsieve.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        out.append((len(b), len(b) - len(kept), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def mixed_texts(seed):
    rng = random.Random(seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randint(15, 90), "abcdeé") for _ in range(8)]
    texts = [None, "", "short", "a" * 150, "ab" * 80, "a" * 19, "xyz" * 30 + "é" * 40]
    for _ in range(60):
        parts = [rng.choice([rng.choice(shared), rng.choice(shared)[5:], word(rng.randint(1, 40), "abcdefghij ü")]) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    return texts + texts[8:11]


def rows_of(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1000), (3, 2)])
def test_equals_brute_force(spark, seed, hot):
    texts = mixed_texts(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string").repartition(3)
    got = suffixes.remove_repeats(frame, length=20, gram=6, hot=hot)
    assert rows_of(got) == sorted((i, *r) for i, r in enumerate(plain(texts, 20)))


def test_repeated_and_null_ids(spark):
    texts = ["abcdefghij" * 3, "0123456789" * 2 + "x", "0123456789" * 2 + "x", None]
    rows = list(zip([5, 5, 5, None], texts, strict=True))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=6)
    assert rows_of(got) == sorted((-1 if i is None else i, *r) for i, r in zip([5, 5, 5, None], plain(texts, 20), strict=True))
    assert suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_equal_short_hashes_under_one_id(spark):
    """Different texts of one id stay apart even where a 32-bit hash of them agrees."""
    made = F.concat(F.sha2(F.col("id").cast("string"), 256), F.left(F.sha2(F.hex("id"), 256), F.lit(17)))
    texts = spark.range(300_000).select(made.alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first()["t"][:2]
    rows = [(5, pair[0]), (5, pair[1]), (7, "x" + pair[0][:40]), (None, pair[0][20:]), (None, "only here " * 3)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=6)
    assert rows_of(got) == sorted((-1 if i is None else i, *r) for (i, _), r in zip(rows, plain([t for _, t in rows], 20), strict=True))


def test_queue_spills_and_sorts():
    rng = random.Random(5)
    items = [(rng.randint(0, 50), bytes([rng.randint(0, 255)])) for _ in range(9000)]
    queue = suffixes.DiskQueue(memory=20_000)
    for item in items:
        queue.push(item, 10)
    assert queue.runs
    assert list(queue.drain()) == sorted(items)
    queue.close()


def test_registered_query(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op6_suffix_dedup"](spark, SF)
    assert rows_of(got) == sorted((i, *r) for i, r in zip(texts.doc_id, plain(texts.text, 200), strict=True))
