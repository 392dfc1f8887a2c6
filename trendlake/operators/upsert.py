"""Keyed upsert into tables of immutable generations.

An upsert appends the batch as one generation; reading takes the newest row of each key; compact
merges all generations into one. So a write costs what the batch costs, not what the table
costs, is idempotent, and readers never see half of it, as a generation counts from the moment
its name is in the manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POST_TABLE
from .manifest import Manifest


class KeyedTable:
    """A table at `path` with one row for each value of `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str, partition_by: list[str] | None = None):
        self.spark, self.path, self.key, self.partition_by = spark, path.rstrip("/"), key, partition_by or []
        self.manifest = Manifest(spark, path)

    def generations(self) -> list[tuple[int, str]]:
        """(number, name) of the generations that count, oldest first."""
        return [(n, name) for n, name in self.manifest.newest()[1] or []]

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, int]:
        """A new generation that doesn't count yet: its name, and how many rows its files hold."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}").count()

    def upsert(self, batch: DataFrame, order: Column | None = None) -> int:
        """Adds or replaces rows; the last by `order` wins within the batch. Gives the rows written.

        The batch's plan runs once. A batch without rows leaves the table as it is.
        """
        name, written = self._write(newest(batch, self.key, order if order is not None else F.lit(0)), "g")
        while written:
            version, known = self.manifest.newest()
            number = max((n for n, _ in known or []), default=-1) + 1
            if self.manifest.publish(version, [*(known or []), [number, name]]):
                break
        return written

    def read(self) -> DataFrame:
        """The newest row of each key."""
        parts = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_generation", F.lit(n)) for n, name in self.generations()]
        if not parts:
            raise FileNotFoundError(self.path)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return newest(rows, self.key, F.col("_generation")).drop("_generation")

    def compact(self) -> None:
        """Merges the generations that count now; those added meanwhile stay beside the merged one."""
        old = self.generations()
        if len(old) < 2:
            return
        name, _ = self._write(self.read(), "c")
        while True:
            version, known = self.manifest.newest()
            if [list(g) for g in known[: len(old)]] != [list(g) for g in old]:
                return  # another compaction was first
            if self.manifest.publish(version, [[old[-1][0], name], *known[len(old) :]]):
                return


def newest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key, the greatest by `order`; combines before the shuffle, so no key is hot."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(packed, order).alias("_row"))
    return best.select("_row.*")


def upsert_posts(table: KeyedTable, posts: DataFrame, collected_at: Column) -> int:
    """Writes the kept columns of posts, stamped; of posts with one URL the last in order stays."""
    last = newest(posts.withColumn("collected_at", collected_at), table.key, F.col("seq"))
    return table.upsert(last.select(*POST_TABLE))


def upsert_keywords(table: KeyedTable, found: DataFrame, updated_at: Column) -> int:
    """Replaces the whole list of each source; a source with no keywords keeps its old list."""
    rows = found.filter(F.col("keywords").isNotNull() & (F.size("keywords") > 0))
    return table.upsert(rows.select("source", "keywords", updated_at.alias("updated_at")))
