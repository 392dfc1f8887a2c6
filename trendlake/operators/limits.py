"""Limits a group, and caps on enrichment.

A limit is a row_number() filter, which Spark turns into a group limit before the shuffle: each
task passes on at most k rows of a group, however large it is. Caps look for the few rows that
are enriched in the same way and join them back by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, group: list[str], pos: str, k: int) -> DataFrame:
    """The first k rows of each group by position."""
    order = Window.partitionBy(*group).orderBy(pos)
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def prefix_limit(rows: DataFrame, valid: Column, group: list[str], pos: str, k: int) -> DataFrame:
    """The valid ones of the first k rows."""
    return first_rows(rows, group, pos, k).filter(valid)


def valid_limit(rows: DataFrame, valid: Column, group: list[str], pos: str, k: int) -> DataFrame:
    """The first k valid rows."""
    return first_rows(rows.filter(valid), group, pos, k)


def both_limit(rows: DataFrame, valid: Column, group: list[str], pos: str, raw: int, k: int) -> DataFrame:
    """The first k valid ones of the first `raw` rows."""
    return valid_limit(first_rows(rows, group, pos, raw), valid, group, pos, k)


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], column: str) -> DataFrame:
    return rows.join(few.select(*keys, F.col(column).alias("_value")), keys, "left")


def enrich_cap(rows: DataFrame, group: list[str], pos: str, image: Column, k: int = 10, out: str = "image_url") -> DataFrame:
    """`out`: the image of the first k rows of a group, found or not; null for the rest."""
    few = first_rows(rows.select(*group, pos, image.alias("_image")), group, pos, k)
    return _joined(rows.drop(out), few, [*group, pos], "_image").withColumnRenamed("_value", out)


def enrich_missing(rows: DataFrame, group: list[str], pos: str, have: Column, image: Column, k: int = 10, out: str = "image_url") -> DataFrame:
    """`out`: a row's own image, or for the first k rows of a group without one the looked-up image."""
    missing = have.isNull() | (have == "")
    few = first_rows(rows.filter(missing).select(*group, pos, image.alias("_image")), group, pos, k)
    own = rows.withColumn("_own", have)
    joined = _joined(own.drop(out) if out in rows.columns else own, few, [*group, pos], "_image")
    looked_up = F.coalesce("_value", F.col("_own"))
    return joined.withColumn(out, F.when(F.col("_own").isNull() | (F.col("_own") == ""), looked_up).otherwise(F.col("_own"))).drop("_own", "_value")
