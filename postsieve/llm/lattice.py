"""Embedding near-dedup by E8 lattice hashing.

Every table projects the unit vectors at random to blocks of eight dimensions and decodes
each block to the nearest point of the E8 lattice; the points together are the cell. A
vector stands in its own cell and probes the neighbouring cells that lie nearest to it.
Vectors that meet are compared by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import components, cut, mix

MIN_COSINE = 0.9
BLOCK_ROWS = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries ±1, or all ±1/2 with even signs."""
    whole = [v for v in product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    half = [v for v in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, dtype=np.float64)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even coordinate sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the integer and half-integer coset."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    better = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(better[:, None], whole, half)


@dataclass(frozen=True)
class Lattice:
    """Parameters of the index. ``reach`` is the length of a lattice unit, ``probes`` the
    number of neighbouring cells that a vector visits in each table."""

    tables: int = 10
    blocks: int = 2
    probes: int = 10
    reach: float = 0.7
    seed: int = 11

    def cells(self, unit: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (n, tables) and probed cells (n, tables, probes) of unit vectors."""
        rng = np.random.default_rng((self.seed, dims))
        near = minimal_vectors()
        own = np.empty((len(unit), self.tables), np.int64)
        other = np.empty((len(unit), self.tables, self.probes), np.int64)
        for t in range(self.tables):
            basis = np.linalg.qr(rng.normal(size=(max(dims, 8 * self.blocks), 8 * self.blocks)))[0][:dims]
            x = unit @ basis * np.sqrt(dims / (8 * self.blocks)) * np.sqrt(self.blocks) / self.reach
            points, costs, steps = [], [], []
            for b in range(self.blocks):
                part = x[:, 8 * b : 8 * b + 8]
                point = decode(part)
                rest = part - point
                cost = 2.0 - 2.0 * rest @ near.T  # growth of the squared distance per neighbour
                best = np.argpartition(cost, self.probes, axis=1)[:, : self.probes]
                points.append(point)
                costs.append(np.take_along_axis(cost, best, 1))
                steps.append(near[best])
            keys = [self._key(p, t, b) for b, p in enumerate(points)]
            own[:, t] = self._join(keys)
            # the cheapest moves: one block to a neighbour, or two blocks at once
            moved = [[self._key((points[b][:, None] + steps[b]).reshape(-1, 8), t, b).reshape(len(unit), -1)] for b in range(self.blocks)]
            choices, prices = [], []
            for b in range(self.blocks):
                choices.append(self._join([moved[b][0] if c == b else keys[c][:, None] for c in range(self.blocks)]))
                prices.append(costs[b])
            if self.blocks == 2:
                few = min(4, self.probes)
                first = [np.argsort(c, axis=1)[:, :few] for c in costs]
                a, b = (np.take_along_axis(moved[i][0], first[i], 1) for i in (0, 1))
                pa, pb = (np.take_along_axis(costs[i], first[i], 1) for i in (0, 1))
                choices.append(self._join([a[:, :, None], b[:, None, :]]).reshape(len(unit), -1))
                prices.append((pa[:, :, None] + pb[:, None, :]).reshape(len(unit), -1))
            choice, price = np.concatenate(choices, 1), np.concatenate(prices, 1)
            best = np.argsort(price, axis=1, kind="stable")[:, : self.probes]
            other[:, t] = np.take_along_axis(choice, best, 1)
        return own, other

    def _key(self, points: np.ndarray, table: int, block: int) -> np.ndarray:
        halves = np.rint(points * 2).astype(np.int64).view(np.uint64)
        h = np.full(len(points), 1 + table * 31 + block, np.uint64)
        for i in range(8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + halves[:, i])
        return h

    @staticmethod
    def _join(keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0]
        for k in keys[1:]:
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + k)
        return h.view(np.int64)


def unit_rows(vectors: list) -> np.ndarray:
    """Unit vectors in double precision, scaled by the largest entry first."""
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(column: str):
    """True for vectors that can link: entries, none null or non-finite, not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def hashed(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """``classes`` (rep, weight, vector) plus own (array) and probes (array, by table)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, same in frame.groupby(frame["vector"].map(len), sort=False):
                for i in range(0, len(same), 2000):
                    part = same.iloc[i : i + 2000]
                    own, probes = lattice.cells(unit_rows(list(part["vector"])), int(dims))
                    yield part.assign(own=list(own), probes=list(probes.reshape(len(part), -1)))

    return classes.mapInPandas(run, "rep long, weight long, vector array<double>, own array<long>, probes array<long>")


def _first_events(own_x, own_y, probes_x, probes_y) -> np.ndarray:
    """Where each pair (smaller id x) meets first: 3 * table + 0 (same cell), 1 (x probes
    y's cell) or 2 (y probes x's cell)."""
    met = np.stack(
        [own_x == own_y, (probes_x == own_y[:, :, None]).any(2), (probes_y == own_x[:, :, None]).any(2)],
        axis=2,
    )
    return met.reshape(len(own_x), -1).argmax(1)


def _compare(block: pd.DataFrame, min_cosine: float, tables: int) -> pd.DataFrame:
    """Links of one block: (a, b, n), with b null for the partners' weight that a gains."""
    block = block.sort_values("rep", kind="stable")
    ids, weight = block["rep"].to_numpy(), block["weight"].to_numpy()
    is_own, part = block["is_own"].to_numpy(), block["part"].to_numpy()
    low, high, table = block["low"].iloc[0], block["high"].iloc[0], int(block["place"].iloc[0])
    unit = unit_rows(list(block["vector"]))
    own = np.stack(block["own"].to_list())
    probes = np.stack(block["probes"].to_list()).reshape(len(block), tables, -1)
    gained = np.zeros(len(block), np.int64)
    parent = np.arange(len(block))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(0, len(block), 256):
        cosine = unit[i : i + 256] @ unit.T
        x, y = np.nonzero(cosine >= min_cosine)
        x += i
        fits = (x < y) & (ids[x] != ids[y]) & (is_own[x] | is_own[y]) & ((part[x] != part[y]) | (low == high))
        x, y = x[fits], y[fits]
        for j in range(0, len(x), 20_000):
            a, b = x[j : j + 20_000], y[j : j + 20_000]
            here = 3 * table + np.where(is_own[a] & is_own[b], 0, np.where(is_own[b], 1, 2))
            first = _first_events(own[a], own[b], probes[a], probes[b]) == here
            a, b = a[first], b[first]
            np.add.at(gained, a, weight[b])
            np.add.at(gained, b, weight[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    some = np.flatnonzero(gained)
    tree = np.array([root(k) for k in some], dtype=np.int64)
    child = some[tree != some]
    links = pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "n": gained[some]})
    edges = pd.DataFrame({"a": ids[child], "b": pd.array(ids[tree[tree != some]], "Int64"), "n": 0})
    return pd.concat([links, edges])


def _blocks(min_cosine: float, tables: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:  # rows come sorted by block; a block may span frames
            key = frame[["cell", "low", "high"]]
            change = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            ends = [*change[1:], len(frame)]
            for a, b in zip(change, ends, strict=True):
                piece = frame.iloc[a:b]
                if held and (held[-1][["cell", "low", "high"]].iloc[0] != piece[["cell", "low", "high"]].iloc[0]).any():
                    yield from finish(held)
                    held = []
                held.append(piece)
        if held:
            yield from finish(held)

    def finish(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(held) if len(held) > 1 else held[0]
        out = _compare(block, min_cosine, tables)
        if len(out):
            yield out

    return run


def link_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    lattice: Lattice = Lattice(),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``rows``: (vec_id, n_links, component_id, kept).

    Equal vectors form one class, which takes part once with its size as weight. Of a
    cell's vectors, blocks of about ``block_rows`` meet pairwise, so no task holds a hot
    cell; a pair counts only where it meets first among all tables, and a block sends
    one number per vector and a forest of links, not its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite entries link with
    nothing, nor do vectors of different lengths or rows without an id; those rows are
    components of their own. Rows that repeat an id count as vectors of their own. Other
    columns are not read.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.filter(usable("vector") & F.col("vec_id").isNotNull())
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    known = cut(hashed(classes.select("rep", "weight", "vector"), lattice))
    per = lattice.probes
    visits = known.select("rep", F.posexplode("own").alias("place", "cell"), F.lit(True).alias("is_own")).union(
        known.select("rep", F.posexplode("probes").alias("at", "cell")).select("rep", F.floor(F.col("at") / per).cast("int"), "cell", F.lit(False))
    )
    owned = F.sum(F.col("is_own").cast("long"))
    busy = cut(visits.groupBy("cell").agg(owned.alias("owned"), F.count("*").alias("total")).filter("owned > 0 and total > 1").select("cell", "total"))
    met = visits.join(busy, "cell")
    parts = F.ceil(F.col("total") / block_rows).cast("int")
    met = met.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("cell", "place", "rep", "is_own", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
    blocks = met.join(known, "rep").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    found = cut(blocks.mapInPandas(_blocks(min_cosine, lattice.tables), "a long, b long, n long"))
    gained = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    trees = components(found.filter("b is not null").select("a", "b"))
    # several classes can share a smallest id when rows repeat ids: links then go to both
    members = good.join(classes.select("vector", "rep", "weight").withColumnRenamed("vector", "_v"), F.col("vector") == F.col("_v"))
    linked = (
        members.select("vec_id", "rep", "weight")
        .join(gained, "rep", "left")
        .join(trees.withColumnsRenamed({"child": "rep", "parent": "least"}), "rep", "left")
        .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    alone = rows.filter(~(usable("vector") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
