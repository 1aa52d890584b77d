import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import listing, listing_frame
from postsieve import defaults
from postsieve.operators import blocklist, scoring
from postsieve.operators.scoring import BLOCKED_MARK, Lexicon, lexicon_frame, score_listings
from postsieve.operators.skew import look_up
from postsieve.operators.targets import apply_target_floor, only_targets


def scores(df):
    return {r.url: (r.score, r.keywords) for r in df.collect()}


def by_hand(text, weights):
    """The matching rule, per row and phrase, for comparison only."""
    found = [p for p in weights if re.search(r"\b" + re.escape(p.lower()) + r"\b", text.lower())]
    return sum(weights[p] for p in found), found


def forms(lexicon):
    """Every physical form of one lexicon."""
    joined = Lexicon.of(lexicon, scan_max=0)
    shuffled = Lexicon(joined.table, None, False, joined.sizes)
    return {"scan": Lexicon.of(lexicon, scan_max=10_000), "join": joined, "shuffled": shuffled}


@pytest.mark.parametrize("form", ["scan", "join", "shuffled"])
def test_edge_cases(spark, form):
    weights = {"Audio Software": 10, "audio software engineer": 9, "ssl": 1, "c++": 2, ".net": 3, "über uns": 4}
    lexicon = forms(lexicon_frame(spark, weights))[form]
    rows = [
        listing("Audio Software Engineer", url="1"),
        listing("fossil", url="2"),
        listing("audio  software", url="3"),
        listing("big audio", url="4", description="software x"),
        listing("audio", url="5", company="software"),
        listing("ssl ssl SSL", url="6"),
        listing("c++", url="7", company="x"),
        listing("c++x", url="8"),
        listing("a.net", url="9"),
        listing(".net", url="10"),
        listing("Über uns", url="11"),
        listing("nothing", url="12", description=None, company=None),
    ]
    got = scores(score_listings(listing_frame(spark, *rows), lexicon))
    assert got == {
        "1": (19, ["Audio Software", "audio software engineer"]),
        "2": (0, []),
        "3": (0, []),
        "4": (10, ["Audio Software"]),
        "5": (0, []),
        "6": (1, ["ssl"]),
        "7": (0, []),
        "8": (2, ["c++"]),
        "9": (3, [".net"]),
        "10": (0, []),
        "11": (4, ["über uns"]),
        "12": (0, []),
    }


@pytest.mark.parametrize("form", ["scan", "join", "shuffled"])
def test_forms_agree_with_the_rule_on_random_text(spark, form):
    rng = random.Random(7)
    alphabet = ["a", "b", "ü", ".", "+", " ", " ", "_", "1", "Σ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 24))) for _ in range(400)]
    phrases = {"".join(rng.choices(alphabet, k=rng.randint(1, 4))): rng.randint(1, 10) for _ in range(200)}
    phrases.update({"\\Ea": 1, "++": 2, "a|b": 3, "it's": 4, 'a"\\n%': 5, "b\nc": 6})
    texts += ["x\\Ea", "c++b", "a|b", "it's", 'a"\\n%x', "b\nc"]
    df = listing_frame(spark, *[listing(t, url=str(i), company="a b") for i, t in enumerate(texts)])
    got = scores(score_listings(df, forms(lexicon_frame(spark, phrases))[form], key="url"))
    for i, t in enumerate(texts):
        assert got[str(i)] == by_hand(f"{t}  a b", phrases), t


def test_join_form_without_key_handles_copies(spark):
    df = listing_frame(spark, *[listing("audio dsp", url="same") for _ in range(50)])
    lexicon = forms(lexicon_frame(spark, {"audio dsp": 10}))["join"]
    out = score_listings(df, lexicon)
    assert out.count() == 50 and {r.score for r in out.collect()} == {10}


def test_empty_phrase_is_rejected(spark):
    with pytest.raises(Exception, match="empty phrase"):
        Lexicon.of(lexicon_frame(spark, {"": 1}))


def test_template_lexicon(spark):
    df = listing_frame(
        spark,
        listing("Audio DSP Engineer", url="1", description="real-time audio, JUCE and field recording."),
        listing("Director of Sound", url="2", description="audio dsp"),
        listing("DBA team", url="3"),
        listing("DBA", url="4"),
    )
    got = scores(score_listings(df, lexicon_frame(spark, defaults.KEYWORD_WEIGHTS), defaults.TITLE_BLOCKLIST))
    assert got["1"] == (45, ["audio dsp", "dsp engineer", "real-time audio", "juce", "field recording"])
    assert got["2"] == (0, [BLOCKED_MARK])  # 'cto' in 'Director'
    assert got["3"] == (0, [BLOCKED_MARK])
    assert got["4"] == (0, [])


@pytest.mark.parametrize("heavy", [1, 3, 5_000])
def test_look_up_equals_a_join(spark, heavy):
    keys = ["a"] * 50 + ["b"] * 5 + ["c", "d", None, "e"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    table = spark.createDataFrame([("a", 1, 50), ("b", 2, 5), ("c", 3, 1), ("x", 4, 0)], "k string, v int, n int")
    for how in ("inner", "left"):
        got = look_up(rows, table, ["k"], "n", how, heavy)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table.drop("n"), "k", how).collect()))


@pytest.mark.parametrize("longest", [1, 4])
def test_long_phrases_and_shared_words(spark, monkeypatch, longest):
    """Keys of one word up to GRAM_WORDS words, phrases longer than any key, shared words."""
    monkeypatch.setattr(scoring, "GRAM_WORDS", longest)
    rng = random.Random(longest)
    words = ["red", "blue", "ü", "x_1", "c++", "big"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)] + ["red, blue big red", "red  blue"]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 7))): rng.randint(1, 9) for _ in range(250)}
    phrases.update({"red blue": 3, "red, blue": 4, "--": 5, "++ ": 6})
    df = listing_frame(spark, *[listing(t, url=str(i), company="a--b") for i, t in enumerate(texts)])
    lexicon = lexicon_frame(spark, phrases)
    for form in ("join", "shuffled"):
        got = scores(score_listings(df, forms(lexicon)[form], key="url"))
        for i, t in enumerate(texts):
            assert got[str(i)] == by_hand(f"{t}  a--b", phrases), t


def test_phrases_that_share_a_word_have_keys_of_their_own(spark):
    lexicon = Lexicon.of(lexicon_frame(spark, {f"zq{i} audio engineer": 1 for i in range(100)}), scan_max=0)
    assert lexicon.sizes == (3,) and lexicon.table.groupBy("gram").count().agg(F.max("count")).first()[0] == 1
    pairs = {f"{a} {b}": 1 for a in "abcdefghijklmno" for b in "abcdefghijklmno"}
    lexicon = Lexicon.of(lexicon_frame(spark, pairs), scan_max=0)
    assert lexicon.sizes == (2,) and lexicon.table.groupBy("gram").count().agg(F.max("count")).first()[0] == 1


def test_blocklist_table_short_and_long(spark, monkeypatch):
    df = listing_frame(spark, *[listing(t, url=t) for t in ("Director", "sound", "SOUND Dev", "", "dba x")], listing(None, url="null"))
    table = spark.createDataFrame([("CTO",), ("dev",), ("dba ",), (None,)], "pattern string")
    want = {"Director": True, "sound": False, "SOUND Dev": True, "": False, "dba x": True, "null": False}
    for scanned, broadcast in ((1000, 1 << 20), (0, 1 << 20), (0, 0)):
        monkeypatch.setattr(blocklist, "SCAN_MAX_PATTERNS", scanned)
        monkeypatch.setattr(blocklist, "BROADCAST_MAX_BYTES", broadcast)
        for patterns in (table, ["CTO", "dev", "dba ", None]):
            got = blocklist.blocked_by_title(df, patterns)
            assert got.columns[-1] == "blocked" and {r.url: r.blocked for r in got.collect()} == want
        assert blocklist.blocked_by_title(df, ["zz", ""]).filter("not blocked").count() == 0
        assert blocklist.blocked_by_title(df, table.limit(0)).filter("blocked").count() == 0
    assert blocklist.blocked_by_title(df, []).filter("blocked").count() == 0


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_long_blocklist_equals_substring_tests(spark, monkeypatch, broadcast):
    monkeypatch.setattr(blocklist, "SCAN_MAX_PATTERNS", 0)
    monkeypatch.setattr(blocklist, "BROADCAST_MAX_BYTES", broadcast)
    rng = random.Random(3)
    alphabet = ["a", "b", "ü", "😀", "%", "\n", "'", " ", "Σ"]
    titles = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)] + ["x" * 50_000 + "needle"]
    patterns = ["".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(40)] + ["needle", "xxxy", "absent pattern"]
    df = listing_frame(spark, *[listing(t, url=str(i)) for i, t in enumerate(titles)])
    got = {r.url: r.blocked for r in blocklist.blocked_by_title(df, patterns).collect()}
    assert got == {str(i): any(p.lower() in t.lower() for p in patterns) for i, t in enumerate(titles)}


def test_patterns_go_by_their_rarest_gram(spark):
    counts = spark.createDataFrame([("abc", 9), ("bcd", 2), ("cde", 5), ("x", 1)], "gram string, n long")
    patterns = spark.createDataFrame([("abcde",), ("abcz",), ("x",), ("ab",)], "pattern string")
    assert {tuple(r) for r in blocklist.rarest_grams(patterns, counts).collect()} == {("abcde", "bcd", 2), ("x", "x", 1)}


def test_target_floor(spark):
    names = spark.createDataFrame([("Acme",), ("ACME",), ("Über",)], "name string")
    df = listing_frame(
        spark,
        listing("plain", company="aCme", url="1"),
        listing("cto", company="Acme", url="2"),
        listing("audio dsp", company="acme", url="3"),
        listing("plain", company="Other", url="4"),
        listing("plain", company="ÜBER", url="5"),
        listing("plain", company=None, url="6"),
    )
    out = apply_target_floor(score_listings(df, lexicon_frame(spark, {"audio dsp": 7}), ["CTO"]), names)
    assert scores(out) == {
        "1": (1, ["[aCme target]"]),
        "2": (1, ["[Acme target]"]),
        "3": (7, ["audio dsp"]),
        "4": (0, []),
        "5": (1, ["[ÜBER target]"]),
        "6": (0, []),
    }
    assert {r.url: r.blocked for r in out.collect()}["2"] is True
    assert {r.url for r in only_targets(df, names).collect()} == {"1", "2", "3", "5"}


def test_scan_form_has_no_shuffle(spark):
    df = listing_frame(spark, listing("a"))
    plan = score_listings(df, lexicon_frame(spark, defaults.KEYWORD_WEIGHTS), defaults.TITLE_BLOCKLIST)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_many_target_names_are_joined(spark, monkeypatch):
    from postsieve.operators import targets

    names = spark.createDataFrame([("Acme",), ("ACME",), (None,)], "name string")
    df = listing_frame(spark, listing("a", company="aCME", url="1"), listing("b", company=None, url="2"))
    for most in (1000, 0):
        monkeypatch.setattr(targets, "SCAN_MAX_NAMES", most)
        assert {r.url: r.is_target for r in targets.mark_targets(df, names).collect()} == {"1": True, "2": False}
        assert [r.url for r in only_targets(df, names).collect()] == ["1"]
    assert targets.mark_targets(df, names.limit(0)).filter("is_target").count() == 0


def test_broadcast_needs_a_proven_size(spark):
    from postsieve.operators.sizes import at_most, broadcast_if_small, hashed_bytes

    df = spark.range(100).selectExpr("repeat('x', 10) as a")
    assert hashed_bytes(df) == 4 * 100 * (64 + 8 + 10) and hashed_bytes(df.limit(0)) == 0
    hinted = lambda d: "strategy=broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, 1000))
    assert len(at_most(df, 100)) == 100 and at_most(df, 99) is None


def test_a_shuffled_lexicon_moves_no_text_to_find_candidates(spark):
    """Copies collapse as keys and grams; wide rows are neither grouped nor sorted."""
    rows = [listing("of the day", description=f"b {i % 3}", url=str(i), pos=i) for i in range(60)]
    df = listing_frame(spark, *rows)
    lexicon = replace(Lexicon.of(lexicon_frame(spark, {"of the": 7, "the day b": 2}), scan_max=0), fits_broadcast=False)
    scored = score_listings(df, lexicon)
    assert [(r["score"], r["count"]) for r in scored.groupBy("score").count().collect()] == [(9, 60)]
    moved = []
    held = scoring._held

    def seen(texts, key, lexicon):
        moved.append(texts._jdf.queryExecution().executedPlan().toString())
        return held(texts, key, lexicon)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(scoring, "_held", seen)
        plan = score_listings(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert len(moved) == 1 and "Aggregate" not in moved[0] and "Exchange" not in moved[0]
    assert "ShuffledHashJoin [_key" in plan and "SortMergeJoin [_key" not in plan


def test_texts_are_split_once(spark):
    """No filter below the explode makes and splits every text a second time."""
    rows = listing_frame(spark, listing("of the day", description="", company=None, url="1"), listing("", company="", url="2"), listing(".a-", url="3"))
    texts = rows.select("url", scoring.search_text("title", "description", "company").alias("text"))
    long = Lexicon.of(lexicon_frame(spark, {"of the": 7, "a": 2, "day": 1}), scan_max=0)
    one_word = Lexicon.of(lexicon_frame(spark, {"a": 2, "day": 1}), scan_max=0)
    assert long.sizes == (1, 2) and one_word.sizes == (1,)
    for found in (scoring._met(texts, "url", long), scoring._met(texts, "url", one_word), scoring._held(texts, "url", long)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1, plan
    want = {"1": (8, ["of the", "day"]), "2": (0, []), "3": (2, ["a"])}
    weights = {"of the": 7, "a": 2, "day": 1}
    for form in ("scan", "join", "shuffled"):
        assert scores(score_listings(rows, forms(lexicon_frame(spark, weights))[form])) == want
