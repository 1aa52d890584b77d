"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles. Equal sets form one record. Two records that reach
the threshold share a shingle among their rarest ones (shingles of long lists come last in
the order, by their counts; the others follow the hash), their heads. Short inverted lists
of head shingles name candidates in a join. A long list is cut into blocks, and every block
is searched for records whose heads share as many shingles as their sizes ask for: the
longest lists of a block are set apart, the short ones merged with a heap, and the long ones
probed by binary search (DivideSkip). The same search over all shingles settles candidates.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.llm.common import byte_pieces, components, cut, lean, mix
from postsieve.llm.words import GRAM_STEP, SPACED, grams, split_words
from postsieve.operators.skew import look_up

WORDS, PERCENT = 4, 85
LONG_LIST = 6
LOCAL_LIST = 2  # occurrences in one piece of the input that make a shingle worth counting
PIECE_BYTES = 8 << 20
STEP_BYTES = 1 << 18
BLOCK = 256
HEAVY_BYTES = 64 << 20
BROADCAST_IDS = 1_000_000
PAIRED_LIST = 32  # records of a list that meet in a join; longer lists are searched in blocks
LIST_RECORDS, LIST_SHINGLES = 1024, 1 << 18  # of a block, about
PIVOTS = 32  # of a group of near copies of one size, about
SIZE_STEP = math.log(1.04)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer than k words make one shingle,
    no words none."""
    words = split_words(texts, SPACED)
    every = grams(words.hashes, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words.hashes[a:b]:
                h = mix(h * GRAM_STEP + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n can reach the threshold with."""
    return -(-percent * n // 100)


class Order:
    """The global order of shingles: those without long lists by hash, then the others by
    ascending count. Any order gives the same links; this one keeps candidate lists short."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by_token = np.argsort(tokens)
        self.tokens = tokens[by_token]
        self.place = np.empty(len(tokens), np.int64)
        self.place[np.lexsort((self.tokens, counts[by_token]))] = np.arange(len(tokens))

    def head(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The first of a sorted set of shingles, of which any partner has at least one."""
        count = len(shingles) - needed(len(shingles), percent) + 1 if len(shingles) else 0
        if len(self.tokens) and count:
            at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
            late = self.tokens[at] == shingles
            if late.any():
                last = shingles[late][np.argsort(self.place[at[late]])]
                shingles = np.concatenate((shingles[~late], last))
        return shingles[:count]


def divide_skip(lists: list[list[int]], need: list[int], short: int) -> dict[int, int]:
    """How many of the ascending ``lists`` hold each number x, for all x in at least
    ``need[x]`` of them.

    ``short`` lists (the shortest) are merged with a heap; x is a candidate when they hold
    it often enough for the long lists to make up the rest, which are probed one by one
    until x is certain or lost.
    """
    lists = sorted(lists, key=len)
    few, long = lists[:short], lists[short:]
    heap = [(x[0], i, 0) for i, x in enumerate(few) if x]
    heapq.heapify(heap)
    found = {}
    while heap:
        x, seen = heap[0][0], 0
        while heap and heap[0][0] == x:
            _, i, at = heap[0]
            seen += 1
            if at + 1 < len(few[i]):
                heapq.heapreplace(heap, (few[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        left = len(long)
        if seen + left < need[x]:
            continue
        for values in long:
            at = bisect_left(values, x)
            left -= 1
            if at < len(values) and values[at] == x:
                seen += 1
            elif seen + left < need[x]:
                break
        if seen >= need[x]:
            found[x] = seen
    return found


def search(query: np.ndarray, records: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Positions of the records whose Jaccard with ``query`` reaches ``percent``."""
    n = len(query)
    if not n:
        return []
    sizes = [len(r) for r in records]
    # overlap o suffices when 100 * o >= percent * (n + size - o)
    need = [-(-percent * (n + s) // (100 + percent)) for s in sizes]
    fits = [i for i, s in enumerate(sizes) if s and need[i] <= min(n, s)]
    if not fits:
        return []
    joined = np.concatenate([records[i] for i in fits])
    owner = np.repeat(np.array(fits), [sizes[i] for i in fits])
    at = np.minimum(np.searchsorted(query, joined), n - 1)
    hit = query[at] == joined
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # owners ascend within each list
    bounds = np.searchsorted(at[order], np.arange(n + 1)).tolist()
    owners = owner[order].tolist()
    lists = [owners[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    # a record that reaches its need misses at most n - need lists: one more holds it
    short = n - min(need[i] for i in fits) + 1
    return sorted(divide_skip(lists, need, short))


class HeadLists:
    """Inverted lists over the heads of some records, apart for sizes that lie close together."""

    def __init__(self, sizes: list[int], heads: list[list[int]], percent: int):
        self.sizes, self.percent = sizes, percent
        self.classes: dict[int, dict[int, list[int]]] = {}
        self.ranges: dict[int, tuple[int, int]] = {}
        for i, (n, head) in enumerate(zip(sizes, heads, strict=True)):
            of = int(math.log(n) / SIZE_STEP)
            low, high = self.ranges.get(of, (n, n))
            self.ranges[of] = min(low, n), max(high, n)
            lists = self.classes.setdefault(of, {})
            for token in head:
                lists.setdefault(token, []).append(i)

    def needed(self, n: int, m: int) -> int:
        """How many head shingles sets of n and m share at least if they reach the threshold:
        what lies behind both heads adds at most the longer rest."""
        both = -(-self.percent * (n + m) // (100 + self.percent))
        return max(both - needed(max(n, m), self.percent) + 1, 1)

    def partners(self, n: int, head: list[int]) -> list[int]:
        """The records that may reach the threshold with a set of n, by their heads."""
        found = []
        for of, inverted in self.classes.items():
            low, high = self.ranges[of]
            if 100 * min(n, high) < self.percent * max(n, low):
                continue
            lists = [inverted[t] for t in head if t in inverted]
            # the need rises up to size n and falls behind it, but for rounding
            least = max(min(self.needed(n, low), self.needed(n, high)) - 1, 1)
            if len(lists) >= least:
                found += divide_skip(lists, _Needs(self, n), len(lists) - least + 1)
        return found


class _Needs:
    """The need of each record of ``lists`` with a set of n."""

    def __init__(self, lists: HeadLists, n: int):
        self.lists, self.n = lists, n

    def __getitem__(self, i: int) -> int:
        return self.lists.needed(self.n, self.lists.sizes[i])


Head = tuple[int, int, int, list[int]]  # id, set size, component, head


def across(left: list[Head], right: list[Head] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (a, b), a < b, of different components that their heads allow to link, one of
    each block; of the same block where ``right`` is None. As one of a pair lies outside the
    most frequent component, only such records are searched for."""
    usual = Counter(part for side in (left, right or []) for _, _, part, _ in side).most_common(1)[0][0]
    for asked, index, again in [(left, left, False)] if right is None else [(left, right, False), (right, left, True)]:
        if all(part == usual for _, _, part, _ in asked):
            continue
        lists = HeadLists([n for _, n, _, _ in index], [head for *_, head in index], percent)
        for rep, n, part, head in asked:
            if part == usual:
                continue
            for i in lists.partners(n, head):
                other, _, of, _ = index[i]
                # a pair that is asked for from both ends counts once
                if of != part and (of == usual or not again and (right is not None or rep < other)):
                    yield min(rep, other), max(rep, other)


def search_long_lists(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (token, blocks, rep, n, part, head) that share a token, lie
    in different components and may link by their whole heads; a pair may come repeatedly.

    Every list is dealt into its ``blocks``, and any two of them meet in a cell of their own.
    """
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select(
        "token",
        F.least("block", "with").alias("low"),
        F.greatest("block", "with").alias("high"),
        (F.col("block") > F.col("with")).cast("int").alias("side"),
        "rep",
        "n",
        "part",
        "head",
    )
    cell = ["token", "low", "high"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sides = None, ([], [])

        def finish():
            if key[1] < key[2] and not all(sides):
                return
            pairs = across(sides[0], sides[1] if key[1] < key[2] else None, percent)
            while some := list(islice(pairs, 50_000)):
                yield pd.DataFrame(some, columns=["a", "b"], dtype="int64")

        for frame in frames:
            for token, low, high, side, rep, n, part, head in frame.itertuples(index=False, name=None):
                if (token, low, high) != key:
                    if key is not None:
                        yield from finish()
                    key, sides = (token, low, high), ([], [])
                sides[side].append((rep, n, part, head.tolist()))
        if key is not None:
            yield from finish()

    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(lean(run), "a long, b long")


def mixed_lists(lists: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Rows (token, rep, n, at, part, held, blocks) of those ``lists`` (token, rep, n, at) that
    still hold several components; ``blocks`` is 0 where the records of a list meet in a join."""
    known = lists.select("token", "rep", "n", "at").join(stars.withColumnsRenamed({"child": "rep"}), "rep", "left")
    known = cut(known.select("token", "rep", "n", "at", F.coalesce("parent", "rep").alias("part")))
    heads = F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    blocks = F.greatest(F.ceil(F.col("held") / LIST_RECORDS), F.ceil(F.col("heads") / LIST_SHINGLES)).cast("int")
    mixed = known.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("held"), heads.alias("heads"))
    mixed = mixed.filter("low < high").select("token", "held", F.when(F.col("held") > PAIRED_LIST, blocks).otherwise(0).alias("blocks"))
    return cut(look_up(known, cut(mixed), ["token"], "held"))


def with_pivots(many: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a record of the lists ``many`` (token, rep, n, at, part) and a
    pivot of its list in another component, which their heads allow to link.

    Each list has a pivot for every class of sizes that lie close together: a record of which
    the least part of the head lies outside these lists, so that has the least of its own and
    links with the most; among equals the least by a hash, which lists of the same PIVOTS
    share. Records meet the pivot of their class, and pivots that of the class below. So a
    list sends no more pairs than it has records and classes.
    """
    rows = many.select("token", F.floor(F.log("n") / SIZE_STEP).alias("class"), "rep", "part")
    heads = first.select("rep", F.size("head").alias("size"))
    own = many.groupBy("rep").agg(F.count("*").alias("shared")).join(heads, "rep").select("rep", (F.col("size") - F.col("shared")).alias("own"))
    hashed = F.xxhash64(F.pmod("token", F.lit(PIVOTS)), "rep")
    least = F.min(F.struct("own", hashed.alias("hash"), "rep", "part")).alias("pivot")
    ends = rows.join(own, "rep").groupBy("token", "class").agg(F.count("*").alias("held"), least)
    ends = cut(ends.select("token", "class", "held", F.col("pivot.rep").alias("r"), F.col("pivot.part").alias("p")))
    below = F.lag("class").over(W.partitionBy("token").orderBy("class")).alias("class")
    rows = rows.union(ends.select("token", below, "r", "p"))
    pairs = look_up(rows, ends, ["token", "class"], "held").filter("part <> p")
    pairs = cut(pairs.select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).distinct())
    one, other = (first.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("head").alias(f"head_{x}")) for x in "ab")
    common = F.size(F.array_intersect("head_a", "head_b"))
    # what lies behind both heads adds at most the longer rest
    rest = F.ceil(percent * F.greatest("n_a", "n_b") / 100) - 1
    enough = common + rest >= F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return pairs.join(one, "a").join(other, "b").filter(enough).select("a", "b").distinct()


RECORDS = "doc_id long, n_shingles long, digest binary, head array<long>"


def record_rows(docs: DataFrame, shared: Broadcast, k: int, percent: int) -> DataFrame:
    """RECORDS of each row: set size, digest of the set, and its head in the ``shared`` order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part, texts in byte_pieces(batch.column(1), STEP_BYTES):
                sets = shingle_sets(texts, k)
                heads = [shared.value.head(s, percent).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(heads, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "head"],
                )

    return docs.mapInArrow(lean(run), RECORDS)


def long_lists(docs: DataFrame, k: int, percent: int, long_list: int = LONG_LIST, local: int = LOCAL_LIST) -> Order:
    """The order that puts frequent shingles last.

    Every piece of the input (PIECE_BYTES of texts) counts all its shingles, equal sets
    once, and sends those with ``local`` and more; the sums that reach ``long_list`` make
    the order. A missed count costs time, never a link. Where the frequent shingles would
    take more than HEAVY_BYTES, the bar rises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0
        for batch in batches:
            for _, texts in byte_pieces(batch.column(0), STEP_BYTES):
                held += shingle_sets(list(dict.fromkeys(texts)), k)
                used += sum(map(len, texts))
                if used >= PIECE_BYTES:
                    yield frequent(held)
                    held, used = [], 0
        if held:
            yield frequent(held)

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        once = {s.tobytes(): s for s in sets}  # equal sets count once
        tokens, counts = np.unique(np.concatenate(list(once.values())), return_counts=True)
        often = counts >= local
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

    counts = docs.select("text").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter(F.col("n") >= long_list))
    while counts.filter(F.col("n") >= long_list).count() > HEAVY_BYTES // 16:
        long_list *= 2
    found = counts.filter(F.col("n") >= long_list).toArrow()
    return Order(found.column("token").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy())


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, repeated: bool = True) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that reach the threshold.

    The records a of one b come in blocks with b's set as query, so a popular b costs one
    set per block, and no task holds more than one block. ``repeated`` says whether ids
    may occur in several rows of ``docs``.
    """
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(few, F.col("doc_id") == F.col("id"), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part, some in byte_pieces(batch.column(1), STEP_BYTES):
                sets = shingle_sets(some, k)
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    sets = texts.mapInArrow(lean(sets_of), "id long, shingles binary")
    sets = cut(sets.distinct() if repeated else sets)
    per = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = pairs.join(per, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    members = dealt.join(sets, F.col("a") == F.col("id")).select("b", "block", F.lit(False).alias("query"), "a", "shingles")
    queries = per.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    queries = queries.join(sets, F.col("b") == F.col("id")).select("b", "block", F.lit(True), F.col("b").alias("a"), "shingles")
    blocks = members.union(queries).repartition("b", "block").sortWithinPartitions("b", "block", F.desc("query"), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, asked, ids, records = None, [], [], []

        def finish():
            hits = sorted({(ids[i], key[0]) for q in asked for i in search(q, records, percent)})
            return pd.DataFrame(hits, columns=["a", "b"], dtype="int64")

        for frame in frames:
            for b, block, query, a, blob in frame.itertuples(index=False, name=None):
                if (b, block) != key:
                    if asked:
                        yield finish()
                    key, asked, ids, records = (b, block), [], [], []
                found = np.frombuffer(blob, np.uint64)
                if query:
                    asked.append(found)
                else:
                    ids.append(a)
                    records.append(found)
        if asked:
            yield finish()

    return blocks.mapInPandas(lean(run), "a long, b long")


def join_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = WORDS,
    percent: int = PERCENT,
    long_list: int = LONG_LIST,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    Documents link when 100 * intersection >= percent * union of their sets; component_id
    is the smallest id reachable by links, the own id included. Links whose ends are
    connected already by others need no test, so three rounds suffice: the promising ones of
    every list are first compared with its smallest and its largest id, those of long lists
    that still hold several components then with pivots, and lists that hold several even
    then give all pairs of different components. A group of near copies is one component
    after the second round, but for those that link with few, and sends no pairs in the
    third. Lists of more than PAIRED_LIST records form no pairs but are searched, block by
    block, for those whose heads share enough. Pairs that share too few head shingles for
    their sizes are not compared.

    Null and empty texts, and texts without words, have no shingles and link with
    nothing; so do rows without an id. Rows that repeat an id are one document with
    several texts: any of them may link it. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(long_lists(docs, k, percent, long_list))
    rows = cut(record_rows(docs, shared, k, percent))
    shared.destroy()
    able = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(able.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    repeated = not able.groupBy("doc_id").count().filter("count > 1").isEmpty()
    first = able.join(classes, "digest").filter("doc_id = rep")
    first = cut(first.dropDuplicates(["digest"]) if repeated else first)
    lists = first.select("rep", F.col("n_shingles").alias("n"), F.posexplode("head").alias("at", "token"))
    ends = [f(F.struct("rep", "n", "at")).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    shared = cut(lists.groupBy("token").agg(*ends).filter("low.rep < high.rep"))
    live = cut(lists.join(shared, "token"))

    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    # a shared shingle at places (at, place): so many can come before it, and after it
    around = F.least("at", "place") + 1 + F.least(F.col("n") - F.col("at") - 1, F.col("m") - F.col("place") - 1)

    def able_to_link(rows: DataFrame) -> DataFrame:
        """Of rows (rep, n, r, m), one for each shared head shingle, the pairs (a, b) that
        can still reach the threshold by how many they share; what lies behind both heads
        adds at most the longer rest."""
        pairs = rows.groupBy(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).agg(
            F.count("*").alias("common"),
            F.min(F.col("n") + F.col("m")).alias("both"),
            F.max(F.greatest("n", "m")).alias("longest"),
        )
        rest = F.ceil(percent * F.col("longest") / 100) - 1
        enough = F.col("common") + rest >= F.ceil(percent * F.col("both") / (100 + percent))
        return cut(pairs.filter(enough).select("a", "b"))

    # pairs that meet mostly in lists that neither of them ends are left to the second round
    star = live.select("rep", "n", "at", F.explode(F.array("low", "high")).alias("end"))
    star = star.select("rep", "n", "at", F.col("end.rep").alias("r"), F.col("end.n").alias("m"), F.col("end.at").alias("place"))
    tested = able_to_link(star.filter((F.col("rep") != F.col("r")) & (around >= need)))
    links = cut(verified(tested, docs, k, percent, repeated))
    stars = components(links)

    left = mixed_lists(live, stars, percent)
    many = left.filter("blocks > 0")
    if not many.isEmpty():
        tried = cut(with_pivots(many, first, percent).join(tested, ["a", "b"], "left_anti"))
        links = cut(links.union(verified(tried, docs, k, percent, repeated)))
        tested = cut(tested.union(tried))
        stars = components(links)
        left = mixed_lists(left, stars, percent)
    few = left.filter("blocks = 0")
    right = few.select(F.col("token").alias("t"), F.col("rep").alias("r"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("part").alias("p"))
    cross = (F.col("token") == F.col("t")) & (F.col("part") < F.col("p")) & (around >= need)
    more = able_to_link(few.join(right, cross).select("rep", "n", "r", "m"))
    many = left.filter("blocks > 0").drop("at").join(first.select("rep", "head"), "rep")
    more = more.union(search_long_lists(many, percent)).distinct()
    more = cut(more.join(tested, ["a", "b"], "left_anti"))
    links = links.union(verified(more, docs, k, percent, repeated))
    stars = components(links)

    placed = rows.join(classes, "digest", "left").join(stars.withColumnRenamed("child", "rep"), "rep", "left")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    part = F.when(linkable, F.coalesce("parent", "rep")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", part.alias("component_id"))
