"""Prefix trie, line dedup and whitening against plain Python and numpy."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import canonical
from postsieve.llm import catalog, lines, prefix_trie, whitening
from postsieve.operators.skew import look_up

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie


def plain_trie(rows):
    """Nodes by rebuilding every conversation in full."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(t[1:] for t in own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = sum((len(members[p]) - 1) * words(p) for p in below)
        ends = sorted(c for c in who if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children), len(leaves), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def talk_rows():
    rows = []
    for c in [*range(45), 60, 61, 80, 1000, 1001, -3, -40, -41]:
        for t in range((c * 7) % 6 + (c % 3 == 0)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"same words {t} here" if c % 4 else f"own {c} {t}"))
    rows += [(100, None, "user", "null turn first"), (100, 0, None, None), (100, 1, "", ""), (120, 5, "user", "x y　z"), (121, 5, "user", "")]
    rows += [(None, 0, "user", "nobody"), (140, 0, "a", "bc"), (141, 0, "ab", "c"), (160, 0, "user", "long " * 30_000)]
    rows += [(200 + i, t, "user", f"turn {t}") for i in range(20) for t in range(5)]
    return rows


def test_trie_equals_plain(spark):
    rows = talk_rows()
    talk = spark.createDataFrame(rows, TALK).withColumns({"fa": F.lit("x"), "conv": F.lit(1), "depth": F.lit(None).cast("int")})
    assert trie_rows(prefix_trie.build(talk.repartition(7))) == plain_trie(rows)


def test_trie_of_deep_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    monkeypatch.setattr(prefix_trie, "ROWS", 11)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000, 20) for t in range(4)] + [(7, t, "user", f"t{t % 5}") for t in range(70)]
    got = prefix_trie.build(spark.createDataFrame(rows, TALK))
    assert trie_rows(got) == plain_trie(rows)


def test_trie_refers_to_stored_turns(spark):
    rows = talk_rows()
    talk = spark.createDataFrame(rows, TALK)
    nodes = prefix_trie.build(talk).filter("depth > 0")
    places = prefix_trie.numbered_turns(talk).select("conv", "pos")
    lost = nodes.join(places, (F.col("ref_conv_id") == F.col("conv")) & (F.col("ref_pos") == F.col("pos")), "left_anti")
    assert lost.count() == 0


def test_trie_starts_again_when_hashes_collide(spark):
    rows = talk_rows()
    seeds = []

    def weak(role, text, seed):
        seeds.append(seed)
        return prefix_trie.turn_hashes(role, text, seed) if seed > 1 else (F.length(text).cast("long"), F.lit(0).cast("long"))

    got = prefix_trie.build(spark.createDataFrame(rows, TALK), digest=weak)
    assert trie_rows(got) == plain_trie(rows) and max(seeds) == 2
    with pytest.raises(ValueError, match="collide"):
        prefix_trie.build(spark.createDataFrame(rows, TALK), digest=lambda r, t, s: (F.lit(1).cast("long"), F.lit(1).cast("long")))


def test_trie_of_tied_and_repeated_turns_is_defined(spark):
    rows = [(20, 1, "user", "b"), (20, 1, "user", "a"), (20, 1, "user", "a"), (40, 1, "user", "a"), (40, 1, "user", "b"), (40, 1, "user", "a")]
    once, again = (trie_rows(prefix_trie.build(spark.createDataFrame(r, TALK))) for r in (rows, rows[::-1]))
    assert once == again and max(r[1] for r in once) <= 3


def test_trie_of_nothing(spark):
    assert prefix_trie.build(spark.createDataFrame([], TALK)).collect() == []
    assert prefix_trie.build(spark.createDataFrame([(None, 1, "a", "b")], TALK)).collect() == []


def test_products_compose_and_invert():
    maps = [prefix_trie.affine(t * 0x9E3779B97F4A7C15 % 2**64 - 2**63, -t) for t in range(1, 9)]
    left = right = prefix_trie.IDENTITY
    for m in maps[:5]:
        left = prefix_trie.then(left, m)
    for m in maps[5:]:
        right = prefix_trie.then(right, m)
    whole = prefix_trie.IDENTITY
    for m in maps:
        whole = prefix_trie.then(whole, m)
    assert prefix_trie.then(left, right) == whole
    assert prefix_trie.then(right, left) != whole and all(a for a, _ in maps)


# --- line dedup


def plain_lines(rows, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.strip(strip).translate(lower)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    keeps = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if key(p) not in keeps or (i is not None and keeps[key(p)] == i)]
        out.append((i, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


COMMON = "A line that many documents hold"


def documents():
    rows = [(i, f"{COMMON}\nown line of document number {i}\n\n  {COMMON.upper()}\t\r") for i in range(40)]
    rows += [(50, f"{COMMON}\n{COMMON}\nmiddle of the last one, it is long\n{COMMON}"), (51, None), (52, ""), (53, "\n\n"), (54, "only a short line")]
    rows += [(55, "É" + "x" * 18), (56, "é" + "x" * 18), (57, "é" + "X" * 19), (58, "é" + "x" * 19), (59, " é" + "x" * 19), (60, "É" + "x" * 19)]
    rows += [(None, COMMON), (None, "null ids hold this very long line"), (61, COMMON), (61, f"{COMMON}\nsame id, other text"), (62, COMMON), (62, COMMON)]
    rows += [(70 + i, "exactly twenty chars" if i else "exactly twenty char") for i in range(5)]
    rows += [(80 + i, "two documents hold it, three rows do" ) for i in (0, 0, 1)]
    rows += [(90, "\n".join(f"line {n % 700} of a very long document" for n in range(60_000)))]
    return rows + [(91 + i, "line 5 of a very long document\nline 699 of a very long document") for i in range(2)]


@pytest.mark.parametrize("heavy", [2])
def test_lines_equal_plain(spark, monkeypatch, heavy):
    monkeypatch.setattr(look_up, "__defaults__", ("inner", heavy))
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "h1": F.lit("x"), "dropped": F.lit(2), "doc": F.lit(3)})
    assert line_rows(lines.drop_repeated_lines(docs.repartition(5))) == plain_lines(rows)


def test_lines_shuffled_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_MAX_BYTES", 0)
    rows = documents()
    assert line_rows(lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_lines(rows)


def test_keep_runs_are_the_kept_lines(spark):
    rows = documents()
    for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        runs = [(x.start, x.start + x.length) for x in r.keep_runs]
        assert all(a < b for a, b in runs) and all(b < c for (_, b), (c, _) in zip(runs, runs[1:], strict=False))
        assert sum(b - a for a, b in runs) == r.n_lines - r.n_dropped


def test_lines_of_nothing(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_plan_has_no_python(spark):
    plan = lines.drop_repeated_lines(spark.createDataFrame(documents(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_range_partition_is_the_only_regrouping_by_line(spark):
    """The first occurrences come from the order of the range partitions, without another exchange."""
    places = lines.line_places(spark.createDataFrame(documents(), "doc_id long, text string")).repartitionByRange("h1", "h2", "id")
    from pyspark.sql import Window as W

    marked = places.withColumn("first", F.row_number().over(W.partitionBy("h1", "h2", "id").orderBy("pos")) == 1)
    assert marked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


# --- whitening


def plain_whitening(vectors, k=4):
    x = [np.floor(256 * np.array(v, dtype=np.float64)) for v in vectors]
    distinct = np.unique(np.array(x), axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    c = (distinct * n - sums) / n
    v = c.T @ c / n
    values, components = np.linalg.eigh(v)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    white = (np.array(x) * n - sums) / n @ components / np.sqrt(values)
    return n, [int(((a * n - sums) ** 2).sum()) for a in x], white, values / np.trace(v)


@pytest.mark.parametrize("d", [2, 64])
def test_whitening_equals_numpy(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(300, d)) * np.linspace(1, 3, d) + 5).astype(np.float32).tolist()
    vectors += vectors[:100] + [vectors[0]] * 50
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    bad = [(900, None, 0), (901, [], 0), (902, [None] + [1.0] * (d - 1), 0), (903, [float("nan")] * d, 0), (904, [float("inf")] * d, 0), (905, [1.0] * (d + 1), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x int").withColumn("dims", F.lit("no"))
    got = whitening.whiten(df.repartition(6)).toPandas().sort_values(["vec_id", "component"])
    n, deviations, white, explained = plain_whitening(vectors)
    k = min(4, d)
    assert got["vec_id"].tolist() == [i for i in range(len(vectors)) for _ in range(k)]
    assert set(got["n"]) == {n} and got["deviation"].tolist() == [x for x in deviations for _ in range(k)]
    assert got["deviation_exact"].astype(int).tolist() == got["deviation"].tolist()
    found = got["whitened"].to_numpy().reshape(-1, k)
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(-1, k)[0], explained, rtol=1e-10)
    assert got["identity_error"].max() < 1e-9


def test_whitening_of_few_dimensions_and_huge_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)]  # rank 1
    flat = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 10 and abs(flat[0].explained - 1) < 1e-12
    huge = [(None, [1e12, -1e300, 0.1]), (2, [-1e12, 1e300, 0.2]), (2, [5e11, 1e18, 0.3])]
    got = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None and int(r.deviation_exact) > 2**63 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0]), (2, [1.0])], [(1, None), (2, [])]])
def test_whitening_without_spread(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_cholesky_and_rotations_rebuild_the_matrix():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (6, 6), (33, 20), (64, 3)):
        a = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, v, atol=1e-10 * np.abs(v).max())
        columns = whitening.rotated(factor)
        gram = columns.T @ columns
        norms = np.sqrt(np.diag(gram))
        assert np.abs(gram / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-13
        assert (np.diff(norms) <= 1e-9 * norms[0]).all()


# --- the registered queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_line_dedup"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    kinds = {"parent_conv_id": "Int64"} if name.startswith("op11") else {}
    got = canonical(catalog.QUERIES[name](spark, SF).toPandas().astype(kinds))
    assert got == canonical(duck.execute(catalog.ORACLES[name]).df().astype(kinds))


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = catalog.QUERIES["op13_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    n, deviations, white, explained = plain_whitening(table.sort_values("vec_id")["embedding"].tolist())
    found = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(found * np.sign((found * white).sum(axis=0)) - white).max() < 1e-9
    assert got["deviation"].tolist() == [x for x in deviations for _ in range(4)] and set(got["n"]) == {n}
