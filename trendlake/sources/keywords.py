"""Trending keywords of four sources, by functions over the raw page (no tree, no Python).

Each extractor takes pages (source, html) and gives an ordered array of (keyword, url), at most
ten, or an error where the page's structure is not as expected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote, strip, unquote

MOST = 10
SOURCES = ["danawa", "daum", "daangn", "namuwiki"]
#: Pages and referrers (fixed values).
PAGES = {
    "danawa": ("https://search.danawa.com/dsearch.php?query=best", "https://www.danawa.com/"),
    "daum": ("https://search.daum.net/search?w=tot&q=%E3%84%B4%E3%84%B4", "https://www.daum.net/"),
    "daangn": ("https://www.daangn.com/kr/buy-sell/", "https://www.daangn.com/"),
    "namuwiki": ("https://namu.news/", "https://namu.wiki/"),
}
#: Patterns of items and the addresses that keywords lead to (fixed values).
DANAWA_ITEM = r'<a href="/dsearch\.php\?query=[^"]*" target="_self" title="([^"]+)">'
DAUM_ITEM = r'data-keyword="([^"]+)"'
DAANGN_ITEM = r'(?U)href="/kr/buy-sell/s/\?search=([^"&]+)"[^>]*>[\s\x{1c}-\x{1f}]*([^<]+?)[\s\x{1c}-\x{1f}]*<'
NAMUWIKI_ITEM = r'(?U)"WikiRank","no":\d+,"keyword":"([^"]+)","url":"([^"]+)"'
DANAWA_URL = "https://search.danawa.com/dsearch.php?query="
DAUM_URL = "https://search.daum.net/search?q="
DAANGN_URL = "https://www.daangn.com/kr/buy-sell/s/?search="

_TYPE = "array<struct<keyword:string,url:string>>"


def _groups(html: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _items(words: Column, url: str) -> Column:
    return F.transform(F.slice(words, 1, MOST), lambda k: F.struct(k.alias("keyword"), F.concat(F.lit(url), quote(k)).alias("url"))).cast(_TYPE)


def danawa_section(html: Column) -> Column:
    """From the first marker to the end of its list; null without a marker."""
    # One split in two, so that later markers stay in the text.
    parts = F.split(html, "hot_keyword", 2)
    return F.split_part(F.get(parts, 1), F.lit("</dl>"), F.lit(1))


def daum_section(html: Column) -> Column:
    """After the second marker, or after the only one; null if that is empty or missing."""
    parts = F.split(html, "list_trend", -1)
    section = F.when(F.size(parts) > 2, F.get(parts, 2)).otherwise(F.get(parts, 1))
    return F.split_part(F.nullif(section, F.lit("")), F.lit("</ul>"), F.lit(1))


def danawa(html: Column) -> tuple[Column, Column]:
    section = danawa_section(html)
    return _items(_groups(section, DANAWA_ITEM, 1), DANAWA_URL), F.when(section.isNull(), F.lit("no hot_keyword section"))


def daum(html: Column) -> tuple[Column, Column]:
    section = daum_section(html)
    return _items(_groups(section, DAUM_ITEM, 1), DAUM_URL), F.when(section.isNull(), F.lit("no list_trend section"))


def daangn(html: Column) -> tuple[Column, Column]:
    """Links with text, the first of each text."""
    both = F.arrays_zip(_groups(html, DAANGN_ITEM, 1).alias("raw"), F.transform(_groups(html, DAANGN_ITEM, 2), strip).alias("text"))
    seen = F.filter(both, lambda x: x["text"] != "")
    texts = F.transform(seen, lambda x: x["text"])
    first = F.filter(seen, lambda x, i: F.array_position(texts, x["text"]) == i + 1)
    words = F.transform(first, lambda x: unquote(x["raw"]))
    return _items(words, DAANGN_URL), F.when(F.size(words) == 0, F.lit("no popular searches"))


def namuwiki(html: Column) -> tuple[Column, Column]:
    pairs = F.arrays_zip(_groups(html, NAMUWIKI_ITEM, 1).alias("keyword"), _groups(html, NAMUWIKI_ITEM, 2).alias("raw"))
    url = lambda raw: F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).otherwise(raw)
    items = F.transform(F.slice(pairs, 1, MOST), lambda p: F.struct(p["keyword"].alias("keyword"), url(p["raw"]).alias("url"))).cast(_TYPE)
    return items, F.when(F.size(items) == 0, F.lit("no WikiRank data"))


EXTRACTORS: dict[str, Callable[[Column], tuple[Column, Column]]] = {"danawa": danawa, "daum": daum, "daangn": daangn, "namuwiki": namuwiki}


def extract_keywords(pages: DataFrame, *keep: str) -> DataFrame:
    """(source, html[, error]) to (source, source_rank, keywords, error); a failing source doesn't stop others.

    keep: further columns that go along.
    """
    items, error = F.lit(None).cast(_TYPE), F.lit(None).cast("string")
    for name in reversed(SOURCES):
        found, wrong = EXTRACTORS[name](F.col("html"))
        mine = F.col("source") == name
        items, error = F.when(mine, found).otherwise(items), F.when(mine, wrong).otherwise(error)
    if "error" in pages.columns:  # why there is no page
        error = F.coalesce(F.col("error"), error)
    rank = F.array_position(F.lit(SOURCES), F.col("source")).cast("int") - 1
    return pages.filter(F.col("source").isin(SOURCES)).select(*keep, "source", rank.alias("source_rank"), F.when(error.isNull(), items).alias("keywords"), error.alias("error"))
