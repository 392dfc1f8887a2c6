"""Pages: over HTTP by a Python data source, or at rest; bytes to text."""

from __future__ import annotations

import gzip
import re
import time
import urllib.request
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .keywords import PAGES
from .sites import EXTRA_HEADERS, REGISTRY, list_address

#: Seconds before a request by kind, timeout and attempts (fixed values).
DELAY = {"list": 2.0, "keyword": 1.0, "detail": 0.5}
TIMEOUT = {"list": 10.0, "keyword": 10.0, "detail": 5.0}
ATTEMPTS = {"list": 3, "keyword": 3, "detail": 1}
#: Headers of every request (fixed values).
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,*/*;q=0.8",
    "Accept-Language": "ko-KR,ko;q=0.9,en-US;q=0.8,en;q=0.7",
    "Sec-Ch-Ua": '"Not A(Brand";v="99", "Google Chrome";v="121", "Chromium";v="121"',
    "Sec-Ch-Ua-Mobile": "?0",
    "Sec-Ch-Ua-Platform": '"Windows"',
    "Sec-Fetch-Dest": "document",
    "Sec-Fetch-Mode": "navigate",
    "Sec-Fetch-Site": "none",
    "Sec-Fetch-User": "?1",
    "Upgrade-Insecure-Requests": "1",
}
SCHEMA = "source string, url string, body binary, error string"


class _Request(InputPartition):
    def __init__(self, source: str, url: str, kind: str, headers: dict[str, str]):
        super().__init__(url)
        self.source, self.url, self.kind, self.headers = source, url, kind, headers


def _plain(body: bytes, encoding: str | None) -> bytes:
    """The body as it was before the server compressed it."""
    kind = (encoding or "").strip().lower()
    if kind in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    return zlib.decompress(body) if kind == "deflate" else body


def fetch(url: str, kind: str, headers: dict[str, str], pause=time.sleep) -> bytes:
    """The body; tries again after any failure, and raises the last one."""
    for attempt in range(ATTEMPTS[kind]):
        pause(DELAY[kind])
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS | headers), timeout=TIMEOUT[kind]) as response:
                return _plain(response.read(), response.headers.get("Content-Encoding"))
        except Exception:
            if attempt + 1 == ATTEMPTS[kind]:
                raise
    raise AssertionError("no attempts")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        o = self.options
        if "urls" in o:
            return [_Request(o.get("source", ""), u, o.get("kind", "detail"), {}) for u in o["urls"].split("\n") if u]
        if o.get("kind") == "keyword":
            return [_Request(name, url, "keyword", {"Referer": referer}) for name, (url, referer) in PAGES.items()]
        return [_Request(s.site, list_address(s), "list", EXTRA_HEADERS.get(s.site, {})) for s in REGISTRY]

    def read(self, partition):
        """One row a request: a body, or the error of the source that failed."""
        try:
            yield partition.source, partition.url, fetch(partition.url, partition.kind, partition.headers), None
        except Exception as e:  # noqa: BLE001  one source's failure must not end the others
            yield partition.source, partition.url, None, f"{type(e).__name__}: {e}"


class HttpPages(DataSource):
    """spark.read.format("http_pages"): options kind (list, keyword, detail) or urls, one a line.

    Every request is a partition, so sources are read side by side and fail alone.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPages)


def fetch_pages(requests: DataFrame, kind: str = "detail") -> DataFrame:
    """(source, url) to (source, url, body, error), for addresses that an earlier step found.

    Requests to one source go out one after the other, in one task; sources side by side. A failure
    is a row. The result is not stored: a reader that needs it twice should checkpoint it.
    """

    def run(batches):
        for batch in batches:
            sources, urls = (c.to_pylist() for c in batch.columns)
            bodies, errors = [], []
            for source, url in zip(sources, urls):
                try:
                    bodies.append(fetch(url, kind, EXTRA_HEADERS.get(source, {})))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  it is reported, and must not end the others
                    bodies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], ["source", "url", "body", "error"])

    return requests.select("source", "url").repartition("source").mapInArrow(run, SCHEMA)


_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w-]+)""", re.IGNORECASE)


def decode(body: bytes, charset: str | None = None) -> str:
    """Bytes to text: by the given charset with replacements, else the page's own, UTF-8, or cp949."""
    if charset:
        return body.decode(charset, "replace")
    if body.startswith(b"\xef\xbb\xbf"):
        return body.decode("utf-8-sig", "replace")
    named = _META.search(body[:4096])
    for name in [*([named[1].decode("ascii")] if named else []), "utf-8", "cp949"]:
        try:
            return body.decode("cp949" if name.lower() in ("euc-kr", "ks_c_5601-1987") else name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_detected(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: decode(bytes(b)) if b is not None else None)


def decode_pages(pages: DataFrame) -> DataFrame:
    """(source, url, body[, error]) to (source, url, html, error). UTF-8 sites stay in the JVM; others are detected.

    A page that could not be had stays a row, without html and with its error.
    """
    forced = [s.site for s in REGISTRY if s.charset == "utf-8"]
    utf8 = F.make_valid_utf8(F.col("body").cast("string"))
    html = F.when(F.col("source").isin(forced), utf8).otherwise(decode_detected("body"))
    failed = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    error = F.when(F.col("body").isNull(), F.coalesce(failed, F.lit("no body")))
    return pages.select("source", "url", html.alias("html"), error.alias("error"))


def pages_at_rest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Saved pages: one file a page."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(source).alias("source"), F.col("path").alias("url"), F.col("content").alias("body"))
