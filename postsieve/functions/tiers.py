"""Score tiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve import defaults


def _by_floor(score, position: int, base) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    chain = F
    for tier in defaults.TIERS:
        chain = chain.when(score >= tier[0], F.lit(tier[position]))
    return chain.otherwise(F.lit(base))


def tier_label(score="score") -> Column:
    return _by_floor(score, 1, defaults.BASE_TIER[0])


def tier_colour(score="score") -> Column:
    return _by_floor(score, 2, defaults.BASE_TIER[1])
