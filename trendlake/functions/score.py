"""Engagement score with stepwise decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_half_even_2

#: Weights of upvotes, comments and views (fixed values).
UPVOTE, COMMENT, VIEW = 3, 2, 0.1
#: Hours up to which a post has a share of its score, and the share after that (fixed values).
DECAY = [(1, 1.0), (6, 0.7), (12, 0.4), (24, 0.2), (72, 0.08), (168, 0.03)]
OLDEST = 0.02


def hours_between(start: Column, end: Column) -> Column:
    """Hours to the microsecond; both of the same kind of timestamp."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0) / F.lit(3600.0)


def decay(hours: Column) -> Column:
    """Share of the score after so many hours: bounds belong to the younger side, null is oldest."""
    step = F.when(hours <= DECAY[0][0], F.lit(DECAY[0][1]))
    for bound, share in DECAY[1:]:
        step = step.when(hours <= bound, F.lit(share))
    return step.otherwise(F.lit(OLDEST))


def base_score(upvotes: Column, comments: Column, views: Column) -> Column:
    return upvotes * UPVOTE + comments * COMMENT + views * F.lit(VIEW)


def score(upvotes: Column, comments: Column, views: Column, created_at: Column, as_of: Column) -> Column:
    return round_half_even_2(base_score(upvotes, comments, views) * decay(hours_between(created_at, as_of)))
