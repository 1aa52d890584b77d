"""Title blocklist: a listing is blocked when some pattern is a substring of its title.

A short blocklist is one expression per row. A long one goes through a filter of character
q-grams: every pattern is known by the rarest q-gram it holds, titles are looked up by the
q-grams they hold, and only the patterns found are compared. The cost follows the titles and
the matches, not titles × patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.sizes import BROADCAST_MAX_BYTES, at_most, hashed_bytes
from postsieve.operators.skew import look_up
from postsieve.store.folders import ensure_checkpoint_dir

SCAN_MAX_PATTERNS = 256  # a form only; results do not depend on it
Q = 3  # characters of a q-gram; shorter patterns are their own


def literal(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern_frame(df: DataFrame, blocklist: Sequence[str] | DataFrame) -> DataFrame:
    """Distinct lower-cased patterns as a table; nulls are left out."""
    if not isinstance(blocklist, DataFrame):
        rows = [(p,) for p in blocklist if p is not None]
        blocklist = df.sparkSession.createDataFrame(rows, "pattern string")
    return blocklist.select(F.lower("pattern").alias("pattern")).filter(F.col("pattern").isNotNull()).distinct()


def blocked_by_title(df: DataFrame, blocklist: Sequence[str] | DataFrame, title: str = "title") -> DataFrame:
    """Add ``blocked``: some pattern is a case-insensitive substring of the title.

    Up to SCAN_MAX_PATTERNS patterns are tested in the row, also on streams. Longer
    blocklists take a batch: a stream hands its micro-batches over (``score_epochs``).
    """
    rows = at_most(pattern_frame(df, blocklist), SCAN_MAX_PATTERNS) if isinstance(blocklist, DataFrame) else None
    if rows is None and not isinstance(blocklist, DataFrame):
        distinct = {p.lower() for p in blocklist if p is not None}
        rows = [(p,) for p in distinct] if len(distinct) <= SCAN_MAX_PATTERNS else None
    if rows is not None:
        tests = [f"contains(coalesce(lower(`{title}`), ''), {literal(p)})" for p in sorted(r[0] for r in rows)]
        return df.withColumn("blocked", F.expr(" or ".join(tests) or "false"))
    if df.isStreaming:
        raise ValueError(f"a stream takes a blocklist of at most {SCAN_MAX_PATTERNS} patterns; score its micro-batches")
    return _blocked_by_grams(df, pattern_frame(df, blocklist), title)


def grams(text: Column, q: int) -> Column:
    """All runs of ``q`` characters, overlapping, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def rarest_grams(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """(pattern, gram): the gram of each pattern that the fewest titles hold, as ``counts``
    (gram, n) says; patterns with a gram that no title holds cannot match and are left out."""
    size = F.least(F.length("pattern"), F.lit(Q))
    own = F.coalesce(*[F.when(size == q, grams(F.col("pattern"), q)) for q in range(1, Q + 1)])
    held = patterns.select("pattern", F.explode(F.array_distinct(own)).alias("gram")).join(counts, "gram", "left")
    best = held.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return best.filter("best.n > 0").select("pattern", F.col("best.gram").alias("gram"), F.col("best.n").alias("n"))


def matching_titles(titles: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of ``titles`` (title, ...), unique by title, that contain some pattern."""
    sizes = [r.q for r in patterns.select(F.least(F.length("pattern"), F.lit(Q)).alias("q")).distinct().orderBy("q").collect()]
    if 0 in sizes:  # the empty pattern is in every title
        return titles
    if not sizes:
        return titles.limit(0)
    all_grams = F.array_distinct(F.concat(*[grams(F.col("title"), q) for q in sizes]))
    exploded = titles.select("title", F.explode(all_grams).alias("gram"))
    chosen = rarest_grams(patterns, exploded.groupBy("gram").agg(F.count("*").alias("n"))).checkpoint()
    if hashed_bytes(chosen) <= BROADCAST_MAX_BYTES:
        found = exploded.join(F.broadcast(chosen.select("pattern", "gram")), "gram")
    else:  # patterns of one gram travel together, so that the gram is unique
        by_gram = chosen.groupBy("gram").agg(F.collect_list("pattern").alias("patterns"), F.max("n").alias("n"))
        found = look_up(exploded, by_gram.checkpoint(), ["gram"], "n").withColumn("pattern", F.explode("patterns"))
    hits = found.filter(F.contains("title", "pattern")).select("title").distinct()
    return titles.join(hits, "title", "left_semi")


def _blocked_by_grams(df: DataFrame, patterns: DataFrame, title: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    lowered = F.coalesce(F.lower(F.col(f"`{title}`")), F.lit(""))
    titles = df.select(lowered.alias("title")).groupBy("title").agg(F.count("*").alias("rows")).checkpoint()
    blocked = matching_titles(titles, patterns).withColumn("blocked", F.lit(True)).checkpoint()
    keyed = df.drop("blocked").withColumn("_title", lowered)
    hits = blocked.withColumnRenamed("title", "_title")
    if hashed_bytes(hits) <= BROADCAST_MAX_BYTES:
        marked = keyed.join(F.broadcast(hits.drop("rows")), "_title", "left")
    else:
        marked = look_up(keyed, hits, ["_title"], "rows", "left")
    return marked.withColumn("blocked", F.coalesce("blocked", F.lit(False))).drop("_title")
