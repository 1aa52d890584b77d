"""Registry of sources and their union."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.schemas import STAGED
from postsieve.sources import boards, feeds
from postsieve.sources.roster import fits_broadcast, with_company


@dataclass(frozen=True)
class Source:
    """A payload format: its normaliser, its place in the union, and whether its
    endpoints are company boards listed in the roster."""

    kind: str
    normaliser: Callable[[DataFrame], DataFrame]
    rank: int
    is_board: bool = False


class SourceRegistry:
    """Sources by kind. A normaliser maps RAW_PAYLOAD rows of its kind to STAGED rows."""

    def __init__(self, sources: Collection[Source] = ()):
        self._sources = {s.kind: s for s in sources}

    def register(self, source: Source) -> SourceRegistry:
        """A new registry that also holds ``source``."""
        return SourceRegistry([*self._sources.values(), source])

    def kinds(self, boards_only: bool = False) -> list[str]:
        return [s.kind for s in self._sources.values() if s.is_board or not boards_only]

    def board_kinds(self) -> list[str]:
        return self.kinds(boards_only=True)

    def apply(
        self, kind: str, payloads: DataFrame, roster: DataFrame | None = None, small_roster: bool | None = None
    ) -> DataFrame:
        """Normalise the payloads of one kind. A literal filter on ``source_kind`` goes
        first, so a landing table partitioned by it is read once over all kinds."""
        source = self._sources[kind]
        mine = payloads.filter(F.col("source_kind") == F.lit(kind))
        if source.is_board and roster is not None:
            mine = with_company(mine, roster.filter(F.col("ats") == F.lit(kind)), small_roster)
        mine = mine.withColumn("src_rank", F.lit(source.rank)).withColumn(
            "endpoint_ord", F.coalesce("endpoint_ord", F.lit(0))
        )
        out = source.normaliser(mine)
        found = [(f.name, f.dataType.simpleString()) for f in out.schema.fields]
        wanted = [(f.name, f.dataType.simpleString()) for f in STAGED.fields]
        if found != wanted:
            raise TypeError(f"source {kind!r} yields {found}, expected {wanted}")
        return out


def default_registry(untitled: bool = False) -> SourceRegistry:
    """The six sources; with ``untitled``, postings without a title are listings too."""
    of = lambda normaliser: partial(normaliser, untitled=untitled)
    return SourceRegistry(
        [
            Source("remoteok", of(boards.remoteok), 0),
            Source("wwr", feeds.weworkremotely, 1),
            Source("avixa", feeds.avixa, 2),
            Source("greenhouse", of(boards.greenhouse), 3, is_board=True),
            Source("lever", of(boards.lever), 3, is_board=True),
            Source("ashby", of(boards.ashby), 3, is_board=True),
        ]
    )


def normalise(
    payloads: DataFrame,
    roster: DataFrame,
    registry: SourceRegistry | None = None,
    kinds: Collection[str] | None = None,
    boards_only: bool = False,
) -> DataFrame:
    """Union of all sources as STAGED rows.

    ``kinds`` or ``boards_only`` restricts the sources; the others are not read.
    Copies are kept; arrival order is in src_rank, endpoint_ord, src_pos.
    """
    registry = registry or default_registry()
    chosen = [k for k in registry.kinds(boards_only) if kinds is None or k in kinds]
    if not chosen:
        raise ValueError("no source selected")
    small = fits_broadcast(roster) if set(chosen) & set(registry.board_kinds()) else None
    parts = [registry.apply(k, payloads, roster, small) for k in chosen]
    return reduce(DataFrame.unionByName, parts)
