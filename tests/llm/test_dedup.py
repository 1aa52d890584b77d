"""Exact, embedding and shingle dedup, and connected components, against plain code."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postsieve.llm import common, exact, jaccard, lattice
from postsieve.llm.catalog import OP10_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def roots(ids, links):
    """Smallest reachable id of each."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shape", ["random", "chain", "hub", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    ids = list(range(400))
    links = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(330)],
        "chain": [(i, i + 1) for i in rng.sample(range(399), 399)],
        "hub": [(399, i) for i in range(0, 300)] + [(350, 351), (350, 350)],
        "none": [],
    }[shape]
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.child: r.parent for r in common.components(frame).collect()}
    assert got == {i: r for i, r in roots(ids, links).items() if i != r}


# exact copies

ROWS = [(1, "a", 1), (2, "a", 2), (3, None, 3), (4, "", 4), (5, "A", 5), (6, "x" * 200_000, 6), (7, "x" * 200_000, 7), (7, "b", 8), (7, "b", 9), (None, "c", 0)]


def copies(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, _ in rows:
        keep = max((x for x in groups[t or ""] if x is not None), default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 0), lambda c: F.length(c).cast("string")])
def test_exact_copies_with_any_digest(spark, digest):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id long").repartition(4)
    got = exact.keep_last_copies(frame, digest=digest)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(copies(ROWS), key=key)


def test_drop_copies_keeps_columns(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id long")
    got = exact.drop_copies(frame)
    assert got.columns == frame.columns
    rows = got.collect()
    assert sorted((r.text or "") for r in rows) == sorted({t or "" for _, t, _ in ROWS})
    assert {r.doc_id for r in rows} == {2, 4, 5, 7, None}
    assert exact.drop_copies(frame.limit(0)).count() == exact.keep_last_copies(frame.limit(0)).count() == 0


def test_exact_copies_are_native(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, x long")
    plan = exact.keep_last_copies(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(OP10_SQL).df()
    got = QUERIES["op10_exact_dedup"](spark, SF).toPandas()[want.columns]
    order = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


# embeddings


def test_decode_is_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1.3, (400, 8))
    point = lattice.decode(x)
    doubled = np.rint(point * 2)
    assert (doubled == point * 2).all() and (np.ptp(doubled % 2, axis=1) == 0).all() and (point.sum(1) % 2 == 0).all()
    near = lattice.minimal_vectors()
    assert near.shape == (240, 8)
    own = ((x - point) ** 2).sum(1)
    around = ((x[:, None] - point[:, None] - near) ** 2).sum(2).min(1)
    assert (own <= around + 1e-9).all() and (own <= 1 + 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    index = lattice.Lattice()
    own_a, probes_a = index.cells(a, 64)
    own_b, probes_b = index.cells(b, 64)
    met = (own_a == own_b) | (probes_a == own_b[:, :, None]).any(2) | (probes_b == own_a[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.97


def brute_vectors(rows):
    good = [(i, np.asarray(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(int)
    pairs = []
    for p, (i, v) in enumerate(good):
        for j, w in good[p + 1 :]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    parts = roots([i for i, _ in rows if i is not None], pairs)
    return sorted(((-1 if i is None else i), links[i], -1 if i is None else parts[i], i is None or parts[i] == i) for i, _ in rows)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] + rng.normal(0, 0.05 * (i % 4), 16)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [float("inf")] * 16)]
    rows += [(306, [1.0] * 4), (307, [1.0] * 4), (None, [1.0] * 4), (308, [x * 1e200 for x in rows[0][1]])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int").repartition(5)
    got = lattice.link_vectors(frame, block_rows=16)
    out = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got.collect())
    assert out == brute_vectors(rows)
    assert lattice.link_vectors(frame.limit(0)).count() == 0


def test_vector_query(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op1_lattice_dedup"](spark, SF).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_vectors(list(zip(table.vec_id, table.embedding, strict=True)))


# shingles


def plain_sets(rows, k=4):
    out = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()))
    return out


def brute_documents(rows, k=4, percent=85):
    sets = plain_sets(rows, k)
    lists, pairs = defaultdict(list), []
    for p, (i, s) in enumerate(sets):
        common_to = defaultdict(int)
        for g in s:
            for q in lists[g]:
                common_to[q] += 1
            lists[g].append(p)
        pairs += [(i, sets[q][0]) for q, o in common_to.items() if None not in (i, sets[q][0]) and 100 * o >= percent * (len(s) + len(sets[q][1]) - o)]
    parts = roots([i for i, _ in rows if i is not None], pairs)
    return sorted(((-1 if i is None else i), len(s), -1 if i is None else parts[i]) for i, s in sets)


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(rng.choice([5, 12, 40, 150]))] for _ in range(12)]
    rows = []
    for i in range(260):
        text = list(base[rng.choice([0, 0, 0, *range(12)])])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\t", "\n"]).join(text).upper() if i % 9 == 0 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_equal_brute_force(spark, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE "), (905, "a b c"), (906, "a b c d"), (907, "a b c  d"), (None, "a b c d"), (908, "é ü " * 30_000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, token int").repartition(4)
    got = jaccard.join_documents(frame, long_list=5)
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got.collect())
    assert out == brute_documents(rows)


def test_documents_edges(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.join_documents(frame).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert jaccard.join_documents(frame.limit(0)).count() == 0


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_long_lists_are_searched_in_blocks(spark, monkeypatch, k, percent):
    """A group of which most pairs miss the threshold, cut into blocks of a few records."""
    monkeypatch.setattr(jaccard, "PAIRED_LIST", 6)
    monkeypatch.setattr(jaccard, "LIST_RECORDS", 25)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(240):
        text = base[: rng.choice([150, 150, 150, 140, 125])].copy()
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 6])):
            text[rng.randrange(len(text))] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.join_documents(frame, k=k, percent=percent)
    want = brute_documents(rows, k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == want
    assert 10 < len({part for _, _, part in want}) < 230


def test_pairs_of_a_large_group_grow_with_its_records(spark, monkeypatch):
    """Copies with one to three words of their own, of which few link with the group's ends."""
    searched, tested = [], []
    search, verified = jaccard.search_long_lists, jaccard.verified
    monkeypatch.setattr(jaccard, "search_long_lists", lambda *a: searched.append(search(*a)) or searched[-1])
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: tested.append(pairs) or verified(pairs, *a))
    rng = random.Random(7)
    base = [[f"b{g}_{i}" for i in range(150)] for g in range(2)]
    rows = []
    for i in range(400):
        text = base[i % 30 == 0].copy()
        for _ in range(3 if i in (1, 399) else rng.choice([1, 2, 2, 3])):
            text[rng.randrange(150)] = f"v{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.join_documents(frame, k=5, percent=80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_documents(rows, 5, 80)
    counts = [pairs.distinct().count() for pairs in (*searched, *tested)]
    assert max(counts) < 10 * len(rows), counts


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_across_finds_every_link(percent):
    rng = random.Random(percent)
    for _ in range(60):
        base = rng.sample(range(1000), rng.choice([3, 12, 40]))
        sets = [np.unique(np.array([x for x in base if rng.random() < 0.93] + rng.sample(range(1000), rng.randint(1, 4)), np.uint64)) for _ in range(24)]
        order = jaccard.Order(np.array(base[:2], np.uint64), np.array([9, 7]))
        rows = [(i, len(s), rng.randrange(3), order.head(s, percent).tolist()) for i, s in enumerate(sets)]
        link = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
        want = {(i, j) for i in range(24) for j in range(i + 1, 24) if rows[i][2] != rows[j][2] and link(i, j)}
        whole, (left, right) = list(jaccard.across(rows, None, percent)), (rows[::2], rows[1::2])
        split = [p for some in ((left, None), (right, None), (left, right)) for p in jaccard.across(*some, percent)]
        for got in (whole, split):
            assert len(got) == len(set(got)) and want <= set(got) and all(a < b and rows[a][2] != rows[b][2] for a, b in got)


def test_divide_skip_counts():
    rng = random.Random(8)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(rng.randint(1, 15))]
        need = [rng.randint(1, len(lists)) for _ in range(30)]
        truth = {x: n for x in range(30) if (n := sum(x in s for s in lists)) >= need[x]}
        assert jaccard.divide_skip(lists, need, len(lists) - min(need) + 1) == truth


def test_document_query(spark):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op4_jaccard_join"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_documents(list(zip(table.doc_id, table.text, strict=True)))
