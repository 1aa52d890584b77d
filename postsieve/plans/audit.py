"""Endpoint audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from postsieve.operators import health
from postsieve.sources.roster import unsupported


@dataclass(frozen=True)
class Audit:
    endpoints: DataFrame
    tally: DataFrame
    repairs: DataFrame
    unsupported: DataFrame


def audit(roster: DataFrame, payloads: DataFrame) -> Audit:
    """Classify every roster entry by its endpoint's response.

    ``endpoints`` is narrow (no bodies); store it before using more than one report
    when the responses are many.
    """
    endpoints = health.endpoints(roster, payloads)
    return Audit(
        endpoints,
        health.tally(endpoints),
        health.repairs(endpoints),
        unsupported(roster, health.AUDITED_KINDS),
    )
