"""Continuous ingestion of posts (an extension: the batch engine re-runs on a schedule instead)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.upsert import KeyedTable, upsert_posts
from ..plans.pipeline import process_posts


def stream_posts(posts: DataFrame, table: KeyedTable, checkpoint: str, as_of: Column | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch goes through dedup, filter and score into the table.

    Keep-first needs the whole batch, which a window over a stream can't give, so it is done in
    foreachBatch. A batch that is tried again writes the same rows under the same keys.
    """

    def write(batch: DataFrame, _: int) -> None:
        now = as_of if as_of is not None else F.current_timestamp()
        upsert_posts(table, process_posts(batch, now), now)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_seen(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One post a URL within the watermark, where which of them comes first doesn't matter."""
    return posts.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["source_url"])


def activity(posts: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Posts and upvotes a site and time window, late data up to the delay."""
    windowed = posts.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "source_site")
    return windowed.agg(F.count("*").alias("n_posts"), F.sum("upvotes").alias("upvotes")).select(F.col("window.start").alias("window_start"), "source_site", "n_posts", "upvotes")
