"""Trie of rebuilt conversations, from fingerprints that compose.

Each turn stands for an affine map x → a x + b modulo a prime, and a sequence of turns for
the product of its maps: an element of a group, given by two numbers whatever its length.
A rebuilt conversation is the head of a base conversation followed by a suffix of its own
turns, so the fingerprints of its prefixes are those of the head, and the head's product
times those of the suffix. Texts are read once, where they lie, and never rebuilt; every
prefix keeps the place (conversation and turn) where its last text is stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postsieve.llm.common import cut
from postsieve.operators.skew import look_up

BASE_EVERY = 20  # conversation c starts like c - c % BASE_EVERY
HEADS = 4  # its head has crc32(c) % HEADS turns

PRIME = (1 << 61) - 1
ATTEMPTS = 5  # seeds of turn hashes, before a collision that stays is an error

NODE = ["depth", "fa", "fb"]

# One chunk of sorted ids on its way to a digest.
CHUNK_IDS = 2_000
ROWS = 2_000

Digest = Callable[[Column, Column, int], tuple[Column, Column]]


def turn_hashes(role: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn; the length of the role keeps role and text apart."""
    parts = (F.length(role), role, text)
    return F.xxhash64(F.lit(2 * seed), *parts), F.xxhash64(F.lit(2 * seed + 1), *parts)


def numbered_turns(talk: DataFrame, seed: int = 0, digest: Digest = turn_hashes) -> DataFrame:
    """(conv, pos, turn, t1, t2, words): positions from 1 by turn, null first; turns that tie
    go by their hashes. Texts stay behind: hashes and counts of words alone are regrouped."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t1, t2 = digest(role, text, seed)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = talk.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", t1.alias("t1"), t2.alias("t2"), words.cast("long").alias("words")
    )
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    return turns.withColumn("pos", F.row_number().over(order))


def hashes_are_exact(talk: DataFrame, seed: int, digest: Digest) -> bool:
    """No two different (role, text) have the same hashes: whole contents are grouped, copies
    in their map tasks first, and each pair of hashes must stand for one content."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t1, t2 = digest(role, text, seed)
    contents = talk.filter(F.col("conv_id").isNotNull()).select(t1.alias("t1"), t2.alias("t2"), role.alias("r"), text.alias("t")).distinct()
    return contents.groupBy("t1", "t2").count().filter("count > 1").isEmpty()


def affine(t1: int, t2: int) -> tuple[int, int]:
    """The map of a turn; its first number is never 0, so that maps can be inverted."""
    return int(t1) % (PRIME - 1) + 1, int(t2) % PRIME


def then(first: tuple[int, int], second: tuple[int, int]) -> tuple[int, int]:
    """The product of two fingerprints, the first sequence followed by the second."""
    return first[0] * second[0] % PRIME, (first[1] * second[0] + second[1]) % PRIME


IDENTITY = (1, 0)

PREFIX = "conv long, depth int, fa long, fb long, pa long, pb long, t1 long, t2 long, words long, ref_conv long, ref_pos int, is_end boolean"


def _prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (conv, kind, pos, base, t1, t2, words, n_own, head), per conversation a row of kind
    0 with its head and then its own suffix by position → one row per prefix.

    The suffix's product grows turn by turn; each prefix is the head's product times it. A
    conversation may be cut by a batch anywhere: only its products are kept.
    """
    out: list[tuple] = []
    head, suffix, depth, last, before = IDENTITY, IDENTITY, 0, 0, IDENTITY
    for frame in frames:
        for conv, kind, pos, base, t1, t2, words, own, turns in zip(
            *[frame[c].tolist() for c in ("conv", "kind", "pos", "base", "t1", "t2", "words", "own", "head")], strict=True
        ):
            if kind == 0:
                turns = [] if turns is None else list(turns)
                last = len(turns) + int(own)
                head = suffix = before = IDENTITY
                out.append((conv, 0, *IDENTITY, *IDENTITY, 0, 0, 0, conv, 0, last == 0))
                for depth, t in enumerate(turns, 1):
                    head = then(before, affine(t["t1"], t["t2"]))
                    out.append((conv, depth, *head, *before, t["t1"], t["t2"], t["words"], base, t["pos"], depth == last))
                    before = head
                depth = len(turns)
            else:
                suffix = then(suffix, affine(t1, t2))
                whole, depth = then(head, suffix), depth + 1
                out.append((conv, depth, *whole, *before, t1, t2, words, conv, pos, depth == last))
                before = whole
            if len(out) >= ROWS:
                yield _as_frame(out)
                out = []
    if out:
        yield _as_frame(out)


def _as_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PREFIX.split(", ")])


def prefixes(turns: DataFrame, every: int = BASE_EVERY, heads: int = HEADS) -> DataFrame:
    """One row per rebuilt conversation and depth, see PREFIX: its fingerprint (fa, fb), that
    of the prefix one shorter (pa, pb), and hashes, words and place of its last turn."""
    keep = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("int")
    base = F.col("conv") - F.col("conv") % every
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", base.alias("base"), keep.alias("h"), "n")
    entry = F.struct("pos", "t1", "t2", "words")
    starts = (
        turns.filter((F.col("conv") % every == 0) & (F.col("pos") < heads))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(entry)).alias("start"))
    )
    head = F.slice(F.coalesce("start", F.array().cast("array<struct<pos:int,t1:bigint,t2:bigint,words:bigint>>")), F.lit(1), F.col("h"))
    tops = convs.join(starts, "base", "left").select(
        "conv",
        F.lit(0).alias("kind"),
        F.lit(0).alias("pos"),
        "base",
        *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "words")],
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).cast("long").alias("own"),
        head.alias("head"),
    )
    own = turns.filter(F.col("pos") > keep).select(
        "conv", F.lit(1).alias("kind"), "pos", F.lit(0).cast("long").alias("base"), "t1", "t2", "words",
        F.lit(0).cast("long").alias("own"), F.lit(None).cast(tops.schema["head"].dataType).alias("head"),
    )
    rows = tops.unionByName(own).repartition("conv").sortWithinPartitions("conv", "kind", "pos")
    return rows.mapInPandas(_prefixes, PREFIX)


def grouped(rows: DataFrame) -> DataFrame:
    """One row per node: its smallest member, its members, its parent's fingerprint, and
    whether all of them agree in last turn and parent."""
    same = [F.min(c) == F.max(c) for c in ("t1", "t2", "pa", "pb")]
    agree = same[0] & same[1] & same[2] & same[3]
    return rows.groupBy(*NODE).agg(
        F.min("conv").alias("rep"),
        F.count("*").alias("n_convs"),
        F.first("pa").alias("pa"),
        F.first("pb").alias("pb"),
        F.first("words").alias("words"),
        F.min(F.struct("ref_conv", "ref_pos")).alias("ref"),
        agree.alias("agree"),
    )


def rolled_up(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens), summed over subtrees, in one pass whatever the depth.

    A node's ancestors are the prefixes of its smallest member. The nodes of which a
    conversation is the smallest member are its longest prefixes, so a running sum from its
    end gives what each prefix receives through it; only sums that are not 0 move on.
    """
    given = nodes.select(
        F.col("rep").alias("conv"), "depth", F.lit(0).alias("kind"),
        *[F.lit(0).cast("long").alias(c) for c in ("fa", "fb")],
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    takes = rows.select("conv", "depth", F.lit(1).alias("kind"), "fa", "fb", *[F.lit(0).cast("long").alias(c) for c in ("leaves", "saved")])
    deepest = W.partitionBy("conv").orderBy(F.col("depth").desc(), "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = given.unionByName(takes).withColumns(
        {"leaves": F.sum("leaves").over(deepest), "saved": F.sum("saved").over(deepest)}
    )
    moving = sums.filter("kind = 1 and (leaves > 0 or saved > 0)")
    return moving.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (node, conv) rows → (node, first conv, ids joined by commas) in chunks."""
    held: list[str] = []
    key, first = None, None

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*key, first, ",".join(held))], columns=[*NODE, "first", "ids"])

    for frame in frames:
        out = []
        for *at, conv in zip(*[frame[c].tolist() for c in (*NODE, "conv")], strict=True):
            if at != key or len(held) == CHUNK_IDS:
                if held:
                    out.append(row())
                key, first, held = at, conv, []
            held.append(str(conv))
        if out:
            yield pd.concat(out)
    if held:
        yield row()


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted chunks → (node, digest); the hash object is all that is kept of a node."""
    key, state, out = None, None, []
    for frame in frames:
        for *at, ids in zip(*[frame[c].tolist() for c in (*NODE, "ids")], strict=True):
            if at != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= ROWS:
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end. Ids are sorted over the
    whole cluster by node and number and joined to chunks; a node's few chunks are then
    digested in order, as a stream, so a node of any size takes no memory."""
    node = "depth int, fa long, fb long"
    ends = rows.filter("is_end").select(*NODE, "conv")
    spread = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    chunks = spread.mapInPandas(_chunks, f"{node}, first long, ids string")
    met = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return met.select(*NODE, "ids").mapInPandas(_digests, f"{node}, ends_sha256 string")


def build(talk: DataFrame, every: int = BASE_EVERY, heads: int = HEADS, digest: Digest = turn_hashes) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and ref_conv_id and ref_pos, where the node's last turn is
    stored (position in its conversation by turn; 0 for the root).

    Equality is verified, not assumed: turn hashes must stand for one role and text each,
    which whole contents decide, and the members of a node must refer to equal last turns and
    parents. As maps can be inverted, equal fingerprints with equal last turns leave equal
    parents, so the members of a node agree at every depth. Where this fails, all is done
    again with other hashes.

    Null roles and texts are empty, a null turn comes first, turns that tie go by their
    hashes, repeated rows are turns of their own, rows without a conversation id are left
    out, an empty table has no nodes; other columns are not read. A remainder takes the sign
    of the id, as in SQL.
    """
    talk = talk.select("conv_id", "turn", "role", "text")
    for seed in range(ATTEMPTS):
        turns = cut(numbered_turns(talk, seed, digest))
        rows = cut(prefixes(turns, every, heads))
        nodes = cut(grouped(rows))
        if hashes_are_exact(talk, seed, digest) and nodes.filter("not agree").isEmpty():
            return _described(rows, nodes)
    raise ValueError(f"turn hashes collide under {ATTEMPTS} seeds")


def _described(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    parent = nodes.filter("n_children > 0").select(
        F.col("depth").alias("pdepth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("rep").alias("parent_conv_id"),
        F.col("n_children").alias("weight"),
    )
    below = nodes.withColumn("pdepth", F.col("depth") - 1)
    placed = look_up(below, parent, ["pdepth", "pa", "pb"], "weight", "left")
    full = placed.join(rolled_up(rows, nodes), NODE, "left").join(end_digests(rows), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select(
        F.col("rep").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        F.col("ref.ref_conv").alias("ref_conv_id"),
        F.col("ref.ref_pos").cast("long").alias("ref_pos"),
    )
