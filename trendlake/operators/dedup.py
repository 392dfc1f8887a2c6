"""Keep-first dedup.

The first row of each key comes from one aggregate over the input, the row with the least seq. It
combines before the shuffle, so a key may hold any share of the rows: a task passes on at most one
row of it, no task ever sees them all, and the input is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key


def keep_first(rows: DataFrame, *keys: Column, seq: str = "seq", within: tuple[str, ...] = ()) -> DataFrame:
    """The row with the least seq of each key. Null keys count as one key.

    within: columns that are part of every key; seq is unique together with them.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate([*map(F.col, within), *keys])]
    packed = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.groupBy(*named).agg(F.min_by(packed, F.col(seq)).alias("_row"))
    return first.select("_row.*")


def dedup_by_url(posts: DataFrame, seq: str = "seq") -> DataFrame:
    return keep_first(posts, F.col("source_url"), seq=seq)


def dedup_by_title(posts: DataFrame, seq: str = "seq") -> DataFrame:
    return keep_first(posts, title_key("title"), seq=seq)


def dedup(posts: DataFrame, seq: str = "seq") -> DataFrame:
    """By URL, then by title among what is left: a row lost to its URL doesn't claim its title."""
    return dedup_by_title(dedup_by_url(posts, seq), seq)


def first_marked_before(rows: DataFrame, valid: Column, *keys: Column, seq: str = "seq") -> DataFrame:
    """Valid rows that are the first of their key, valid or not."""
    return keep_first(rows, *keys, seq=seq).filter(valid)


def first_marked_after(rows: DataFrame, valid: Column, *keys: Column, seq: str = "seq") -> DataFrame:
    """The first valid row of each key."""
    return keep_first(rows.filter(valid), *keys, seq=seq)
