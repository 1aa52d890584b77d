"""Whitening of embeddings: the scatter is summed over the corpus in Spark, and its
decomposition, whose size depends on the dimensions alone, is done once on the driver.

V = L L' by Cholesky with complete pivoting; one-sided Jacobi rotates the columns of L until
they are orthogonal, L J = U S. Then V = U S**2 U': the squared column norms are the
eigenvalues and the normalised columns the components, without V being touched again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import cut

STEPS = 256  # levels per unit of an entry
COMPONENTS = 4
SWEEPS = 60

# Least ratio of a pivot to the first one, and of the product of two columns to that of
# their norms, that is told from rounding.
RANK_EPS, TURN_EPS = 1e-13, 1e-15

# Row groups whose sums are added up before all meet: sums of more partitions than this are
# combined in two steps.
GROUPS = 64

_LONG = np.iinfo(np.int64)


def levels(matrix: np.ndarray) -> np.ndarray:
    """floor(256 * c) of double entries as long; what a long cannot hold saturates."""
    scaled = np.floor(STEPS * matrix) + 0.0
    out = np.where(np.abs(scaled) < 2.0**63, scaled, 0.0).astype(np.int64)
    out[scaled >= 2.0**63] = _LONG.max
    out[scaled <= -(2.0**63)] = _LONG.min
    return out


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, entries as doubles) → (id, little-endian longs, dims) of the readable vectors."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        keep, packed, dims = [], [], []
        for i, vector in enumerate(column.to_pylist()):
            if vector and None not in vector:
                entries = np.array(vector, dtype=np.float64)
                if np.isfinite(entries).all():
                    keep.append(i)
                    packed.append(levels(entries).astype("<i8").tobytes())
                    dims.append(len(vector))
        taken = ids.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [taken, pa.array(packed, pa.binary()), pa.array(dims, pa.int32())], names=["id", "x", "dims"]
        )


def _longs(packed: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<i8").reshape(-1, d)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of longs, exact whatever their size."""
    if len(x) and int(np.abs(x.astype(np.float64)).max()) * len(x) < 2**62:
        return [int(v) for v in x.sum(axis=0)]
    return [int(v) for v in x.astype(object).sum(axis=0)] if len(x) else [0] * x.shape[1]


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they suffice, Python integers otherwise."""
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0)) * n * 2, max((abs(s) for s in sums), default=0)) + 1
    if most < 2**61:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the exact difference is rounded once and divided once."""
    return _differences(x, n, sums).astype(np.float64) / n


def _pieces(frames: Iterator[pd.DataFrame], d: int) -> Iterator[np.ndarray]:
    step = max(1, (1 << 20) // max(d, 1))
    for frame in frames:
        for i in range(0, len(frame), step):
            yield _longs(frame["x"].iloc[i : i + step], d)


def _totals(matrix_rows: DataFrame, width: int) -> np.ndarray:
    """Sums of the rows (part, at, v) over all parts, per ``at``: combined per group of parts
    first, so that no task adds up more than a group of them."""
    slots = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    near = matrix_rows.groupBy("at", F.pmod("part", F.lit(GROUPS)).alias("g")).agg(*slots)
    far = near.groupBy("at").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    rows = sorted(far.collect(), key=lambda r: r["at"])
    return np.array([[r[f"s{i}"] for i in range(width)] for r in rows], dtype=np.float64)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d × rank) with L L' = V; its rows are in the order of V. Of equal pivots the first
    is taken; pivots below rounding end the factor."""
    d = len(v)
    left = v.copy()
    factor = np.zeros((d, d))
    free = np.ones(d, dtype=bool)
    first = None
    for k in range(d):
        diagonal = np.where(free, np.diag(left), -np.inf)
        p = int(np.argmax(diagonal))
        pivot = diagonal[p]
        first = pivot if first is None else first
        if not pivot > RANK_EPS * first:
            return factor[:, :k]
        column = np.where(free, left[:, p], 0.0) / np.sqrt(pivot)
        factor[:, k] = column
        left -= np.outer(column, column)
        free[p] = False
    return factor


def rotated(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` after one-sided Jacobi: orthogonal, by falling norm.

    Columns are paired in rounds of a tournament; the pairs of a round are disjoint and are
    rotated at once.
    """
    rank = factor.shape[1]
    work = factor.copy()
    if rank > 1:
        even = rank + rank % 2
        players = list(range(even))
        for _ in range(SWEEPS):
            turned = 0.0
            for _ in range(even - 1):
                pairs = [(a, b) for a, b in zip(players[: even // 2], reversed(players[even // 2 :])) if max(a, b) < rank]
                turned = max(turned, _rotate(work, np.array(pairs)))
                players = [players[0], players[-1], *players[1:-1]]
            if turned <= TURN_EPS:
                break
    return work[:, np.argsort(-np.linalg.norm(work, axis=0), kind="stable")]


def _rotate(work: np.ndarray, pairs: np.ndarray) -> float:
    """Make the columns of each pair orthogonal; the largest cosine met before."""
    a, b = work[:, pairs[:, 0]], work[:, pairs[:, 1]]
    aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
    norms = np.sqrt(aa * bb)
    cosine = np.divide(np.abs(ab), norms, out=np.zeros_like(ab), where=norms > 0)
    turn = cosine > TURN_EPS
    if not turn.any():
        return float(cosine.max(initial=0.0))
    zeta = (bb[turn] - aa[turn]) / (2.0 * ab[turn])
    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
    c = 1.0 / np.hypot(1.0, t)
    s = c * t
    left, right = a[:, turn].copy(), b[:, turn].copy()
    work[:, pairs[turn, 0]] = c * left - s * right
    work[:, pairs[turn, 1]] = s * left + c * right
    return float(cosine.max())


@dataclass(frozen=True)
class Whitening:
    """The fit: n vectors of d dimensions with exact sums, and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues by falling size, of all components
    vectors: np.ndarray  # components as columns
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` whitened coordinates of quantised vectors."""
        return _centred(x, self.n, self.sums) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def decompose(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and components of a positive semidefinite matrix, as many
    as its numerical rank."""
    columns = rotated(pivoted_cholesky(v))
    norms = np.linalg.norm(columns, axis=0)
    return norms**2, columns / norms


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x, dims) of the vectors without null or non-finite entries; x holds longs as bytes.

    Vectors of another length than most are unreadable too (of equally frequent lengths the
    longest counts).
    """
    narrow = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    id_type = narrow.schema["id"].dataType.simpleString()
    rows = cut(narrow.mapInArrow(_quantised, f"id {id_type}, x binary, dims int"))
    usual = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.filter(F.col("dims") == (usual["dims"] if usual else 0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors among ``rows`` (see ``quantised``), None where
    there is no row. Copies meet in their map tasks before they are shuffled."""
    first = rows.select("dims").first()
    if first is None:
        return None
    d = first["dims"]
    distinct = cut(rows.select("x").distinct())

    def sums_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * d
        for x in _pieces(frames, d):
            n += len(x)
            total = [a + b for a, b in zip(total, _exact_sums(x), strict=True)]
        if n:
            yield pd.DataFrame({"at": range(d + 1), "s": [str(v) for v in [*total, n]]})

    parts = distinct.mapInPandas(sums_of, "at int, s string")
    exact = {r["at"]: int(r["s"]) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()}
    n, sums = exact[d], [exact[i] for i in range(d)]

    def scatter_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((d, d)), False
        for x in _pieces(frames, d):
            c = _centred(x, n, sums)
            total += c.T @ c
            seen = True
        if seen:
            yield pd.DataFrame({"part": _part(), "at": range(d), "v": list(total)})

    v = _totals(distinct.mapInPandas(scatter_of, "part int, at int, v array<double>"), d) / n
    values, vectors = decompose((v + v.T) / 2)
    fitted = Whitening(n, sums, values, vectors, float(np.trace(v)))
    k = min(components, len(values))
    return Whitening(n, sums, values, vectors, fitted.trace, _identity_error(distinct, fitted, d, k) if k else None)


def _part() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _identity_error(distinct: DataFrame, fitted: Whitening, d: int, k: int) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity; the
    coordinates are centred by their own mean before they are multiplied."""

    def means_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((fitted.project(x, k).sum(axis=0) for x in _pieces(frames, d)), np.zeros(k))
        yield pd.DataFrame({"part": [_part()], "at": [0], "v": [total]})

    mean = _totals(distinct.mapInPandas(means_of, "part int, at int, v array<double>"), k)[0] / fitted.n

    def products_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for x in _pieces(frames, d):
            w = fitted.project(x, k) - mean
            total += w.T @ w
        yield pd.DataFrame({"part": _part(), "at": range(k), "v": list(total)})

    covariance = _totals(distinct.mapInPandas(products_of, "part int, at int, v array<double>"), k) / fitted.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Up to ``components`` rows per readable vector: (id, component, n, deviation, whitened,
    explained, identity_error, deviation_exact).

    Vectors that are null, empty, hold null or non-finite entries, or have another length
    than most give no rows. Copies count once in the fit and each get their rows; ids may be
    null or repeat. Where the vectors span fewer dimensions than ``components``, only those
    exist: an empty table, one distinct vector, or equal vectors give no rows. Eigenvalues
    that tie come in the order of the rotated columns. ``deviation`` is null where a long
    cannot hold it; ``deviation_exact`` writes it out in digits. Other columns are not read.
    """
    rows = quantised(vectors, id_col, vector_col)
    id_type = rows.schema["id"].dataType.simpleString()
    fields = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    fitted = fit(rows, components)
    k = min(components, len(fitted.values)) if fitted else 0
    explained = fitted.values[:k] / fitted.trace if k else None
    d = len(fitted.sums) if fitted else 0

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 20) // max(d, 1))
        for whole in frames:
            for i in range(0, len(whole) if k else 0, step):
                frame = whole.iloc[i : i + step]
                x = _longs(frame["x"], d)
                away = _differences(x, fitted.n, fitted.sums)
                small = away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * d < 2**63
                squares = (away * away if small else away.astype(object) ** 2).sum(axis=1)
                exact = [int(s) for s in squares]
                coordinates = fitted.project(x, k)
                yield pd.DataFrame(
                    {
                        "id": frame["id"].repeat(k).array,
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                        "n": np.int64(fitted.n),
                        "deviation": pd.array([s if s < 2**63 else None for s in exact], dtype="Int64").repeat(k),
                        "whitened": coordinates.reshape(-1),
                        "explained": np.tile(explained, len(x)),
                        "identity_error": fitted.identity_error,
                        "deviation_exact": np.repeat(np.array([str(s) for s in exact], dtype=object), k),
                    }
                )

    return rows.select("id", "x").mapInPandas(rows_of, fields.format(id_type)).withColumnRenamed("id", id_col)
