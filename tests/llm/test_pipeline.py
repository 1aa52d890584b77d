"""The pipeline against plain versions of its stages, and its edge cases."""

from collections import defaultdict

import pandas as pd
import pytest

import corpus_pipeline as cp
from postsieve.llm import mixing, toxicity
from postsieve.llm.common import table
from test_dedup import brute_documents

SF = "/root/testdata/sf0.001"


def plain_after(rows, scores):
    """Ids that stay after each filtering stage, from (id, text) rows."""
    mild = [(i, t) for (i, t), s in zip(rows, scores, strict=True) if s < toxicity.CUT]
    last = defaultdict(lambda: -1)
    for i, t in mild:
        last[t or ""] = max(last[t or ""], i)
    single = [(i, t) for i, t in mild if last[t or ""] == i]
    near = {i for i, _, part in brute_documents(single, cp.NEAR_WORDS, cp.NEAR_PERCENT) if part == i}
    return {i for i, _ in mild}, {i for i, _ in single}, near


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([r.doc_id for r in docs.collect()])
    mild, single, near = plain_after(rows, model.scores([t or "" for _, t in rows]))
    assert [sorted(s) for s in seen] == [sorted(mild), sorted(single), sorted(near), sorted(near)]
    assert seen[3] != sorted(seen[3])  # laid out as the mixture, not by id


def test_near_copies_at_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    copy, other = list(words), list(words)
    copy[30] = copy[60] = "x"  # 86 of 106 five-word shingles, 89 of 105 four-word ones
    other[30] = other[50] = other[70] = "y"  # 81 of 111
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate([words, copy, other], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()) == [1, 3]


def test_near_copies_under_repeated_and_null_ids(spark):
    """An unrelated text stays though its id belongs to a near copy too."""
    words = [f"w{i}" for i in range(60)]
    copy = [*words[:59], "x"]
    other = [f"o{i}" for i in range(60)]
    rows = [(3, words), (5, copy), (5, other), (None, [f"n{i}" for i in range(60)]), (None, [*[f"n{i}" for i in range(59)], "y"]), (7, other), (8, None)]
    rows = [(i, None if t is None else " ".join(t), "en", "a", n) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_dedup(spark, docs.repartition(4), SF).collect()
    assert {r.n_chars for r in kept} in ({0, 2, 3, 6}, {0, 2, 4, 6}) and len(kept) == 4


def test_stages_keep_the_callers_columns(spark):
    clashes = ["row", "_row", "_s", "_h", "_bin", "_n", "_before", "_at", "_block", "_sha", "sha", "_toxic", "score", "id", "at", "version", "digest", "keep"]
    rows = [(i, f"text {i}", "en", "ab"[i % 2], i, *[f"{c}{i}" for c in clashes]) for i in range(40)] + [(3, "text 3", "en", "a", 3, *["again"] * len(clashes))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashes)
    docs = spark.createDataFrame(rows, kinds)
    for stage in (cp.reject_toxic, cp.exact_dedup, cp.near_dedup, cp.mix):
        out = stage(spark, docs, SF)
        got = out.filter("doc_id <> 3").collect()
        assert out.columns == docs.columns and {r.doc_id for r in got} >= set(range(4, 40))
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in clashes)
    mixed = mixing.mix_sources(docs, {"a": 1.0, "b": 1.0}).filter("doc_id <> 3").collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in mixed for c in clashes)


def test_run(spark):
    out = cp.run(spark, SF).toPandas()
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    import hashlib

    assert all(h == hashlib.sha256(texts[i].encode()).hexdigest() for i, h in zip(out.doc_id, out.decoded_sha256, strict=True))
    assert (out.n_tokens * 4 == out.ids.map(len)).all()


def test_repeated_ids_have_places_of_their_own(spark):
    rows = [(i, f"text {n}", "en", s, n) for n, (i, s) in enumerate([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (None, None), (2, None), (3, "b")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.placed(docs).collect()
    assert sorted(r.n_chars for r in out) == list(range(8))
    assert len({(r.mix_slot, r.mix_place) for r in out}) == 8


def test_run_returns_the_mixture(spark):
    out = cp.run(spark, SF).select("doc_id", "source", "mix_slot", "mix_place").toPandas()
    counts = out.source.value_counts().to_dict()
    dealt = {(s, j): slot for s, j, slot, _ in mixing.deal(mixing.exact({s: float(n) ** cp.MIX_POWER for s, n in counts.items()}), counts, mixing.BLOCK_ROWS)}
    # within a source by hash of the id, as the operator says
    hashed = spark.createDataFrame([(int(i),) for i in out.doc_id], "doc_id long").selectExpr("doc_id", "xxhash64('mix', doc_id) AS h")
    order = {r.doc_id: r.h for r in hashed.collect()}
    for source, rows in out.groupby("source"):
        ids = sorted(rows.doc_id, key=lambda i: (order[i], i))
        want = {i: (dealt[source, at // mixing.BLOCK_ROWS], at % mixing.BLOCK_ROWS) for at, i in enumerate(ids)}
        assert {r.doc_id: (r.mix_slot, r.mix_place) for r in rows.itertuples()} == want
    assert len(out) > 100 and not out.duplicated(["mix_slot", "mix_place"]).any()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x", None, "a", 1), (3, "x " * 40_000, "en", "b", 9)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == (3 if rows else 0)
