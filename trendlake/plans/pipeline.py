"""The two runs: posts (extract, dedup, filter, score, write), then keywords (extract, write)."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import dedup
from ..operators.posts import counted, filter_notices, score_all, with_seq
from ..operators.upsert import KeyedTable, upsert_keywords, upsert_posts
from ..session import checkpoint
from ..sources.extract import candidates, detail_requests, posts_of
from ..sources.keywords import extract_keywords
from ..sources.pages import decode_pages, fetch_pages, register
from ..sources.sites import REGISTRY


@dataclasses.dataclass
class Report:
    """Row counts of the stages, and what went wrong by source."""

    collected: int = 0
    deduplicated: int = 0
    kept: int = 0
    saved: int = 0
    keywords_saved: int = 0
    errors: list[tuple[str, str]] = dataclasses.field(default_factory=list)


def process_posts(posts: DataFrame, as_of: Column) -> DataFrame:
    """Dedup, then the noise filter, then the score. The order matters: a noisy post claims its keys."""
    return score_all(filter_notices(dedup(posts)), as_of)


def save_posts(posts: DataFrame, table: KeyedTable, as_of: Column, report: Report | None = None) -> Report:
    """Posts to the post table. All stages are counted as rows pass, in the one write."""
    report = report or Report()
    call = uuid.uuid4().hex  # observations are told apart by name
    collected, seen_collected = counted(posts, f"collected {call}")
    unique, seen_unique = counted(dedup(collected), f"deduplicated {call}")
    kept, seen_kept = counted(filter_notices(unique), f"kept {call}")
    report.saved = upsert_posts(table, score_all(kept, as_of), as_of)
    report.collected, report.deduplicated, report.kept = (s.get.get("rows", 0) for s in (seen_collected, seen_unique, seen_kept))
    return report


def run_posts(pages: DataFrame, table: KeyedTable, as_of: Column, details: DataFrame | None = None, report: Report | None = None, fetch_details: bool = False) -> Report:
    """Pages to the post table. Pages are parsed once; posts, errors and detail addresses come of that.

    With fetch_details the pages that entries link to are fetched, those that the caps allow.
    """
    report = report or Report()
    found = checkpoint(candidates(pages))
    # A row a page that failed, of a registry of some sites.
    report.errors += [(r["source_site"], r["error"]) for r in found.filter(F.col("error").isNotNull()).select("source_site", "error").limit(1000).collect()]
    if fetch_details:
        details = checkpoint(decode_pages(fetch_pages(detail_requests(found)))).filter(F.col("html").isNotNull())
    return save_posts(with_seq(posts_of(found, REGISTRY, as_of, details)), table, as_of, report)


def run_keywords(pages: DataFrame, table: KeyedTable, updated_at: Column, report: Report | None = None) -> Report:
    """Keyword pages to the keyword table; a source that fails or finds nothing keeps its old list."""
    report = report or Report()
    found = checkpoint(extract_keywords(pages))
    report.errors += [(r["source"], r["error"]) for r in found.filter(F.col("error").isNotNull()).select("source", "error").limit(1000).collect()]
    report.keywords_saved = upsert_keywords(table, found, updated_at)
    return report


def run(pages: DataFrame, keyword_pages: DataFrame, posts: KeyedTable, keywords: KeyedTable, as_of: Column, details: DataFrame | None = None, fetch_details: bool = False) -> Report:
    """Both pipelines, one after the other."""
    return run_keywords(keyword_pages, keywords, as_of, run_posts(pages, posts, as_of, details, fetch_details=fetch_details))


def fetched(spark: SparkSession, kind: str) -> DataFrame:
    """All list or keyword pages over HTTP, decoded, each requested once; failures are rows with an error."""
    register(spark)
    return checkpoint(decode_pages(spark.read.format("http_pages").option("kind", kind).load()))


def run_live(spark: SparkSession, folder: str, as_of: Column | None = None) -> Report:
    """Everything over HTTP into the tables `posts` and `keywords` of a folder."""
    posts = KeyedTable(spark, f"{folder}/posts", "source_url", ["source_site"])
    keywords = KeyedTable(spark, f"{folder}/keywords", "source")
    now = as_of if as_of is not None else F.current_timestamp()
    return run(fetched(spark, "list"), fetched(spark, "keyword"), posts, keywords, now, fetch_details=True)
