"""Sources: landed responses of boards and feeds → one listing schema."""

from postsieve.sources.registry import Source, SourceRegistry, default_registry, normalise
from postsieve.sources.roster import first_endpoints, roster_frame, unsupported, with_company, zero_yield

__all__ = [
    "Source",
    "SourceRegistry",
    "default_registry",
    "first_endpoints",
    "normalise",
    "roster_frame",
    "unsupported",
    "with_company",
    "zero_yield",
]
