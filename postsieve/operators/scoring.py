"""Weighted phrase scoring.

A phrase matches where it occurs in the lower-cased search text between word
boundaries. ``match_pattern`` states that rule once, as a regular expression;
the physical forms below only differ in how they avoid evaluating it:

* scan: for a short lexicon. Each phrase is a constant expression of one projection.
  No join, no shuffle, works on streams.
* n-gram join: for a long lexicon. A phrase is known by the run of words it consists of, and
  a text is looked up by its runs of those lengths. Only phrases whose words stand together
  in a text meet it, however many phrases share a word, so the cost does not depend on the
  number of phrases. Streams hand their micro-batches over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.text import search_text
from postsieve.operators.blocklist import blocked_by_title, literal
from postsieve.operators.sizes import BROADCAST_MAX_BYTES, at_most, hashed_width
from postsieve.operators.skew import look_up
from postsieve.schemas import LEXICON, local_frame
from postsieve.store.folders import ensure_checkpoint_dir

BLOCKED_MARK = "[BLOCKED: title match]"  # fixed value

SCAN_MAX_PHRASES = 64  # a form only; results do not depend on it

# Words of a key. Longer phrases are known by the run of so many words that the fewest
# phrases share.
GRAM_WORDS = 4

# A lexicon that cannot be broadcast sends its keys' marks, at most so many whatever its size.
MARKS = 1 << 20

# Letters, numbers and underscore. \w and \b differ between JDK releases.
_WORD = r"[\p{L}\p{N}_]"
_WORDS = r"[\p{L}\p{N}_]+"
_NOT_WORDS = r"[^\p{L}\p{N}_]+"
_HITS = "array<struct<ord:int,phrase:string,weight:int>>"


def lexicon_frame(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """Lexicon table from a phrase → weight mapping, in its own order."""
    return local_frame(spark, [(i, p, int(w)) for i, (p, w) in enumerate(weights.items())], LEXICON)


def match_pattern(needle: Column) -> Column:
    """Regular expression for ``needle`` between word boundaries.

    A boundary lies between a word character and something else, so next to a
    phrase that starts (ends) with a non-word character a word character is needed.
    The phrase comes first in the expression, where the regex engine searches for it
    as plain text; what precedes it is looked at from its end.
    """
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(needle.rlike("^" + _WORD), "(?<!").otherwise("(?<=")
    after = F.when(needle.rlike(_WORD + r"\z"), "(?!").otherwise("(?=")
    return F.concat(quoted, before, F.lit(_WORD), quoted, F.lit(")"), after, F.lit(_WORD + ")"))


def _split(text: Column) -> Column:
    """The words of a text in order; splitting leaves an empty one at either end only."""
    return F.filter(F.split(text, _NOT_WORDS), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Runs of ``n`` consecutive words, joined by one space."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    run = F.slice(words, F.lit(1), count)
    for k in range(2, n + 1):
        run = F.zip_with(run, F.slice(words, F.lit(k), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return run


_COLUMNS = ("ord", "phrase", "weight", "needle", "pattern", "size", "gram", "exact")


def _worded(lexicon: DataFrame) -> DataFrame:
    """Each distinct entry with its lower-cased needle, its pattern and its words."""
    needle, weight = F.lower("phrase"), F.col("weight").cast("int").alias("weight")
    phrases = lexicon.select(F.col("ord").cast("int").alias("ord"), "phrase", weight).distinct()
    return phrases.select("*", needle.alias("needle"), match_pattern(needle).alias("pattern"), _split(needle).alias("_words"))


def prepare_lexicon(worded: DataFrame) -> DataFrame:
    """Add ``gram``, the key by which texts find a phrase, and ``size``, its number of words.

    A phrase without any word matches only where it fills a gap between two words, so it is
    its own key, of size 0. ``exact`` says that the key stands for the whole phrase: a text
    that holds the word holds the phrase.
    """
    count = F.size("_words")
    size = F.least(count, F.lit(GRAM_WORDS))
    runs = F.when(count == 0, F.array("needle"))
    for n in range(1, GRAM_WORDS + 1):
        runs = runs.when(size == n, F.array_distinct(_runs(F.col("_words"), n)))
    each = worded.select("needle", F.explode(runs).alias("gram")).distinct()
    shared = each.groupBy("gram").agg(F.count("*").alias("n"))
    best = each.join(shared, "gram").groupBy("needle").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    exact = (F.col("size") == 1) & (F.col("needle") == F.col("gram"))
    return worded.withColumn("size", size).join(best, "needle").withColumn("exact", exact).select(*_COLUMNS)


@dataclass(frozen=True)
class Lexicon:
    """A lexicon whose size has been looked at, so that a physical form can be chosen."""

    table: DataFrame
    entries: tuple | None  # all rows, when the lexicon is short
    fits_broadcast: bool
    sizes: tuple[int, ...] = ()  # words of the keys of a long lexicon

    @classmethod
    def of(cls, lexicon: DataFrame | Lexicon, scan_max: int = SCAN_MAX_PHRASES) -> Lexicon:
        if isinstance(lexicon, cls):
            return lexicon
        worded = _worded(lexicon)
        entries = at_most(worded.drop("_words"), scan_max)
        if entries is not None:
            if any(not e.phrase for e in entries):
                raise ValueError("empty phrase in lexicon")
            return cls(worded, tuple(sorted(entries, key=lambda e: (e.ord, e.phrase, e.weight))), True)
        ensure_checkpoint_dir(lexicon.sparkSession)
        table = prepare_lexicon(worded).checkpoint()
        empty = F.count_if(F.coalesce(F.length("phrase"), F.lit(0)) == 0)
        kinds = table.groupBy("size").agg(F.sum(hashed_width(table)).alias("bytes"), empty.alias("empty")).collect()
        if any(k["empty"] for k in kinds):
            raise ValueError("empty phrase in lexicon")
        return cls(table, None, sum(k["bytes"] for k in kinds) <= BROADCAST_MAX_BYTES, tuple(sorted(k["size"] for k in kinds)))


def scan_hits(text: str, entries: Sequence) -> Column:
    """Matched (ord, phrase, weight) structs in lexicon order, from the column ``text``.

    One SQL expression: the substring test runs on the stored bytes, and most texts
    need no more; patterns are constants, compiled once per task.
    """
    tests = [
        f"if(contains({text}, {literal(e.needle)}), if(rlike({text}, {literal(e.pattern)}),"
        f" named_struct('ord', {e.ord}, 'phrase', {literal(e.phrase)}, 'weight', {e.weight}), null), null)"
        for e in entries
    ]
    return F.expr(f"array_compact(array({', '.join(tests)}))") if tests else F.array().cast(_HITS)


def _pieces(texts: DataFrame, key: str) -> DataFrame:
    """(key, text, _words): the words of each text in order, with an empty one at an end where
    the text does not begin or end with a word. Keys hold no empty words, so a run with one
    meets no key.

    What is exploded from these is exploded with nulls: below a plain explode Spark filters by
    the size of the array, for which every text would be made and split twice.
    """
    return texts.select(key, "text", F.split("text", _NOT_WORDS).alias("_words"))


def text_grams(texts: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """(key, gram): the distinct runs of words, and gaps between words, of each text; null
    for a text without any."""
    split = _pieces(texts, key)
    keys = [_runs(F.col("_words"), n) for n in sizes if n]
    if 0 in sizes:
        keys.append(F.split("text", _WORDS))
    return split.select(key, F.explode_outer(F.array_distinct(F.concat(*keys))).alias("gram"))


def _met(texts: DataFrame, key: str, lexicon: Lexicon) -> DataFrame:
    """(key, entry) for the entries of a broadcast lexicon whose key a text holds.

    Keys of one word are looked up directly. Where there are longer ones, a word is first
    looked up among those that start a key, and only there the run is put together.
    """
    table = F.broadcast(lexicon.table)
    if max(lexicon.sizes, default=0) <= 1:
        return text_grams(texts, key, lexicon.sizes).join(table, "gram")
    starts = lexicon.table.filter("size > 0").select(F.substring_index("gram", " ", 1).alias("_word"), "size").distinct()
    words = _pieces(texts, key).select(key, "_words", F.posexplode_outer("_words").alias("_pos", "_word"))
    started = words.join(F.broadcast(starts), "_word")
    run = F.array_join(F.slice("_words", F.col("_pos") + 1, F.col("size")), " ")
    met = started.select(key, run.alias("gram")).join(table, "gram")
    return met.unionByName(text_grams(texts, key, (0,)).join(table, "gram")) if 0 in lexicon.sizes else met


def _mark(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(MARKS))


def _held(texts: DataFrame, key: str, lexicon: Lexicon) -> DataFrame:
    """(key, gram): the runs and gaps of each text that may be keys of the lexicon, which
    marks tell: no key is lost, and what shares a key's mark by chance meets no key later.

    Runs are put together only behind a word whose mark starts a key.
    """
    table, sizes = lexicon.table, lexicon.sizes
    starts = table.filter("size > 0").select(_mark(F.substring_index("gram", " ", 1)).alias("_start"), "size").distinct()
    words = _pieces(texts, key).select(key, "_words", F.posexplode_outer("_words").alias("_pos", "_word"))
    started = words.withColumn("_start", _mark("_word")).join(F.broadcast(starts), "_start")
    grams = started.select(key, F.array_join(F.slice("_words", F.col("_pos") + 1, F.col("size")), " ").alias("gram"))
    if 0 in sizes:
        grams = grams.unionByName(text_grams(texts, key, (0,)))
    marks = F.broadcast(table.select(_mark("gram").alias("_mark")).distinct())
    return grams.withColumn("_mark", _mark("gram")).join(marks, "_mark", "left_semi").select(key, "gram")


def candidates(texts: DataFrame, key: str, lexicon: Lexicon, unique: bool = False) -> DataFrame:
    """(key, candidates): the entries whose key stands in each text of ``texts(key, text)``.

    Rows of equal key must have equal text; ``unique`` says that keys do not repeat.
    Candidates are aggregated per key before they are shuffled, so copies of one text collapse
    where they lie; texts are never moved. A lexicon that is too large to be broadcast meets the
    grams that bear a mark of its keys in a shuffle, where grams that fill many texts are
    counted first and broadcast.
    """
    if lexicon.fits_broadcast:
        met = _met(texts, key, lexicon)
    else:
        ensure_checkpoint_dir(texts.sparkSession)
        held = _held(texts, key, lexicon)
        held = (held if unique else held.distinct()).checkpoint()
        counts = held.groupBy("gram").agg(F.count("*").alias("n"))
        phrases = lexicon.table.groupBy("gram").agg(F.collect_list(F.struct("ord", "phrase", "weight", "exact")).alias("e"))
        known = phrases.join(counts, "gram").checkpoint()
        met = look_up(held, known, ["gram"], "n").select(key, F.explode("e").alias("e")).select(key, "e.*")
    return met.groupBy(key).agg(F.collect_set(F.struct("ord", "phrase", "weight", "exact")).alias("candidates"))


def confirmed(text: Column, found: Column) -> Column:
    """The candidates that match, in lexicon order. A substring test spares most patterns."""
    needle = lambda c: F.lower(c["phrase"])
    bounded = lambda c: F.contains(text, needle(c)) & F.regexp_like(text, match_pattern(needle(c)))
    kept = F.array_sort(F.filter(found, lambda c: c["exact"] | bounded(c)))
    return F.transform(kept, lambda c: F.struct(c["ord"].alias("ord"), c["phrase"].alias("phrase"), c["weight"].alias("weight")))


def score_listings(
    df: DataFrame,
    lexicon: DataFrame | Lexicon,
    blocklist: Sequence[str] | DataFrame = (),
    key: str | None = None,
) -> DataFrame:
    """Add ``blocked``, ``score`` and ``keywords`` to listings.

    Blocked listings score 0 and are never searched. ``key`` names a column that is
    unique per row; a long lexicon then joins its matches back on that key and can
    reuse its partitioning. Without one a digest of the text is used.
    """
    lexicon = Lexicon.of(lexicon)
    judged = blocked_by_title(df, blocklist)
    text = search_text("title", "description", "company")
    if lexicon.entries is not None:
        texts = judged.withColumn("_text", F.when(~F.col("blocked"), text))
        matched = texts.withColumn(
            "_hits", F.when(~F.col("blocked"), scan_hits("_text", lexicon.entries))
        ).drop("_text")
    elif df.isStreaming:
        raise ValueError(f"a stream takes a lexicon of at most {SCAN_MAX_PHRASES} phrases; score its micro-batches")
    else:
        row_key = F.col(key) if key else F.sha2(text, 256)
        # blocked rows match nothing; keys of their own keep them from meeting in one task
        apart = F.concat(F.lit("-"), F.xxhash64("title", "url", F.monotonically_increasing_id()).cast("string"))
        keyed = judged.withColumn("_key", F.when(~F.col("blocked"), row_key).otherwise(apart)) if not key else judged
        by = key or "_key"
        texts = keyed.filter(~F.col("blocked")).select(by, text.alias("text"))
        found = candidates(texts, by, lexicon, unique=bool(key)).withColumnRenamed("candidates", "_found")
        # one row per key at most is hashed; the wide rows are not sorted
        joined = keyed.join(found.hint("shuffle_hash"), by, "left")
        doubtful = F.exists("_found", lambda c: ~c["exact"])  # the text is made where something is to be tested
        joined = joined.select(*judged.columns, "_found", F.when(doubtful, text).alias("_text"))
        matched = joined.withColumn("_hits", confirmed(F.col("_text"), F.col("_found"))).drop("_found", "_text")
    hits = F.coalesce(F.col("_hits"), F.array().cast(_HITS))
    score = F.aggregate(hits, F.lit(0), lambda total, h: total + h["weight"])
    phrases = F.transform(hits, lambda h: h["phrase"])
    return matched.select(
        *[c for c in judged.columns],
        score.alias("score"),
        F.when(F.col("blocked"), F.array(F.lit(BLOCKED_MARK))).otherwise(phrases).alias("keywords"),
    )
