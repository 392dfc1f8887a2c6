"""Whole runs, keywords and streams on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from trendlake import queries as Q
from trendlake.operators.upsert import KeyedTable
from trendlake.plans.pipeline import process_posts, run
from trendlake.sources.keywords import extract_keywords
from trendlake.sources.samples import DETAILS, PAGES
from trendlake.streaming.posts import activity, first_seen, stream_posts

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


KEYWORDS = [("daum", 'list_trend <i data-keyword="k1"></i><i data-keyword="k 2"></i></ul>'), ("danawa", "nothing here"), ("namuwiki", '"WikiRank","no":1,"keyword":"n","url":"//w/1"'), ("daangn", "nothing")]


def test_run_twice_is_run_once(spark, tmp_path):
    pages = spark.createDataFrame([(s, f"page of {s}", html) for s, (html, _) in PAGES.items()] + [("clien", "bad", None)], "source string, url string, html string")
    details = spark.createDataFrame(DETAILS, "url string, html string")
    keyword_pages = spark.createDataFrame(KEYWORDS, "source string, html string")
    posts, cache = KeyedTable(spark, str(tmp_path / "posts"), "source_url", ["source_site"]), KeyedTable(spark, str(tmp_path / "cache"), "source")
    report = run(pages, keyword_pages, posts, cache, as_of(), details)
    assert report.collected >= report.deduplicated >= report.kept == report.saved > 0
    assert report.keywords_saved == 2
    assert sorted(e[0] for e in report.errors) == ["clien", "daangn", "danawa"]
    first = sorted(map(str, posts.read().collect()))
    run(pages, keyword_pages, posts, cache, as_of(), details)
    assert sorted(map(str, posts.read().select(*KeyedTable.read(posts).columns).collect())) == first
    assert set(posts.read().columns) == {"title", "source_url", "source_site", "content", "image_url", "upvotes", "comments", "views", "score", "created_at", "collected_at"}


def test_a_run_on_nothing(spark, tmp_path):
    pages = spark.createDataFrame([("clien", "u", None, "timed out")], "source string, url string, html string, error string")
    keyword_pages = spark.createDataFrame([("daum", None, "timed out")], "source string, html string, error string")
    posts, cache = KeyedTable(spark, str(tmp_path / "posts"), "source_url"), KeyedTable(spark, str(tmp_path / "cache"), "source")
    report = run(pages, keyword_pages, posts, cache, as_of())
    assert (report.collected, report.deduplicated, report.kept, report.saved, report.keywords_saved) == (0, 0, 0, 0, 0)
    assert report.errors == [("clien", "timed out"), ("daum", "timed out")]
    assert posts.generations() == cache.generations() == []


def test_keywords(spark):
    got = {r["source"]: r for r in extract_keywords(spark.createDataFrame(KEYWORDS, "source string, html string")).collect()}
    assert [tuple(k) for k in got["daum"]["keywords"]] == [("k1", "https://search.daum.net/search?q=k1"), ("k 2", "https://search.daum.net/search?q=k%202")]
    assert [tuple(k) for k in got["namuwiki"]["keywords"]] == [("n", "https://w/1")]
    assert got["danawa"]["keywords"] is None and got["danawa"]["error"]
    assert [got[s]["source_rank"] for s in ("danawa", "daum", "daangn", "namuwiki")] == [0, 1, 2, 3]


def posts(spark, rows):
    kind = "seq long, title string, source_url string, source_site string, content string, image_url string, upvotes long, comments long, views long, created_at timestamp"
    at = datetime.datetime(2024, 1, 30, 23, 30)
    return spark.createDataFrame([(i, t, u, "s", None, None, 1, 1, 10, at) for i, t, u in rows], kind)


def test_stream_into_the_table(spark, tmp_path):
    source = str(tmp_path / "in")
    posts(spark, [(0, "a fine title", "u0"), (1, "A fine title", "u1"), (2, "공지 read this", "u2")]).coalesce(1).write.parquet(source)
    table = KeyedTable(spark, str(tmp_path / "t"), "source_url")
    stream = spark.readStream.schema(posts(spark, []).schema).parquet(source)
    stream_posts(stream, table, str(tmp_path / "c"), as_of()).awaitTermination(120)
    assert [(r["source_url"], r["score"]) for r in table.read().collect()] == [("u0", 6.0)]
    posts(spark, [(3, "another title", "u3")]).coalesce(1).write.mode("append").parquet(source)
    stream_posts(stream, table, str(tmp_path / "c"), as_of()).awaitTermination(120)
    assert {r["source_url"] for r in table.read().collect()} == {"u0", "u3"}


@pytest.mark.parametrize("make", [first_seen, activity])
def test_stateful_streams(spark, tmp_path, make):
    source = str(tmp_path / "in")
    posts(spark, [(0, "x", "u0"), (1, "y", "u0"), (2, "z", "u1")]).coalesce(1).write.parquet(source)
    stream = make(spark.readStream.schema(posts(spark, []).schema).parquet(source))
    name = f"out_{make.__name__}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("append" if make is first_seen else "update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table(name).collect()
    assert len(got) == 2 if make is first_seen else got[-1]["n_posts"] == 3


def test_process_on_no_posts(spark):
    assert process_posts(posts(spark, []), as_of()).count() == 0


def test_entry_contract(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["seq", "title", "source_url", "source_site", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(Q.SQL[name])
    names = [d[0] for d in rel.description]
    got = Q.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, map(tuple, rel.fetchall())))
