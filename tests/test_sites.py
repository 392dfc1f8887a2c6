"""Every site's extraction on a small page made for it."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from trendlake.sources import extract as E
from trendlake.sources.html_tree import parse
from trendlake.sources.pages import _plain, _Reader, decode, decode_pages, fetch, fetch_pages
from trendlake.sources.samples import DETAILS, OG, PAGES
from trendlake.sources.sites import BY_NAME, REGISTRY, SITES


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(s, f"page of {s}", html) for s, (html, _) in PAGES.items()], "source string, url string, html string")
    details = spark.createDataFrame(DETAILS, "url string, html string")
    rows = E.extract_posts(pages, F.lit("2024-01-31").cast("timestamp"), details, SITES).orderBy("seq").collect()
    return {s.site: [r for r in rows if r["source_site"] == s.site] for s in SITES}


@pytest.mark.parametrize("site", [s.site for s in SITES])
def test_site(found, site):
    got = [(r["title"], r["source_url"], r["upvotes"], r["comments"], r["views"], r["image_url"]) for r in found[site]]
    assert got == PAGES[site][1]


def test_registry():
    assert [s.site for s in REGISTRY] == "clien ruliweb ppomppu mlbpark bobaedream inven dcinside humoruniv 82cook theqoo slrclub todayhumor etoland instiz ygosu natepann".split()
    assert len(_Reader({}).partitions()) == 16
    assert [p.source for p in _Reader({"kind": "keyword"}).partitions()] == ["danawa", "daum", "daangn", "namuwiki"]


def test_limits_of_a_long_list(spark):
    mlb = "".join(f'<p><a href="/mp/b.php?b=x&id={i}">{"ab" if i % 2 else f"title {i}"}</a></p>' for i in range(100))
    eto = "".join(f'<a href="/b?wr_id={i}">{"x" if i % 3 else f"title {i}"}</a>' for i in range(100))
    clien = "".join(f'<div class="list_item symph_row"><a class="list_subject" href="/{i}"><span class="list_subject"><span class="{"other" if i % 2 else "subject_fixed"}">t{i}</span></span></a></div>' for i in range(100))
    pages = spark.createDataFrame([("mlbpark", "m", mlb), ("etoland", "e", eto), ("clien", "c", clien)], "source string, url string, html string")
    counts = {r["source_site"]: r["count"] for r in E.extract_posts(pages, F.lit(None).cast("timestamp")).groupBy("source_site").count().collect()}
    assert counts == {"mlbpark": 30, "etoland": 20, "clien": 15}


def test_enrichment_counts_attempts(spark):
    html = "<table>" + "".join(f'<tr><td><a href="/hot/{i}">title {i}</a></td></tr>' for i in range(15)) + "</table>"
    details = spark.createDataFrame([(f"https://theqoo.net/hot/{i}", OG.format(f"i{i}") if i % 2 else "") for i in range(15)], "url string, html string")
    pages = spark.createDataFrame([("theqoo", "p", html)], "source string, url string, html string")
    rows = E.extract_posts(pages, F.lit(None).cast("timestamp"), details).orderBy("seq").collect()
    assert [r["image_url"] for r in rows] == [f"i{i}" if i % 2 and i < 10 else None for i in range(15)]


def test_a_failing_page_fails_alone(spark):
    pages = spark.createDataFrame([("clien", "bad", None), ("ruliweb", "good", PAGES["ruliweb"][0])], "source string, url string, html string")
    assert E.extract_posts(pages, F.lit(None).cast("timestamp")).count() == 1
    assert [r["source_site"] for r in E.extraction_errors(pages).collect()] == ["clien"]


def test_charsets(spark):
    text = "안녕하세요 세계"
    assert decode(text.encode("euc-kr")) == text
    assert decode(b'<meta charset="euc-kr">' + text.encode("euc-kr")).endswith(text)
    assert decode(text.encode()) == text
    assert decode(b"\xff\xfea", "utf-8") == "��a"
    rows = spark.createDataFrame([("mlbpark", "u", b"a\xffb"), ("humoruniv", "v", text.encode("euc-kr")), ("clien", "w", None)], "source string, url string, body binary")
    assert {r["source"]: r["html"] for r in decode_pages(rows).collect()} == {"mlbpark": "a�b", "humoruniv": text, "clien": None}


def test_fetch_tries_again(tmp_path):
    page, pauses = tmp_path / "p.html", []
    page.write_bytes(b"x")
    assert fetch(page.as_uri(), "list", {}, pauses.append) == b"x"
    assert pauses == [2.0]
    with pytest.raises(Exception):
        fetch((tmp_path / "none").as_uri(), "list", {}, pauses.append)
    assert pauses == [2.0] * 4


def test_http_source_reports_failures_as_rows(spark, tmp_path):
    from trendlake.sources.pages import register

    (tmp_path / "a.html").write_bytes(b"hello")
    register(spark)
    urls = "\n".join([(tmp_path / "a.html").as_uri(), (tmp_path / "none.html").as_uri()])
    rows = spark.read.format("http_pages").option("urls", urls).option("source", "clien").load().collect()
    assert sorted((bytes(r["body"]) if r["body"] else None, r["error"] is None) for r in rows if r["body"]) == [(b"hello", True)]
    assert sum(r["error"] is not None for r in rows) == 1


def test_tree():
    root = parse('<div id="a" class="x y"><p>one<b>two</b></p><br><p class="z">three</p></div><p title="q/w">four')
    assert [n.text() for n in root.select("div#a.x p")] == ["onetwo", "three"]
    assert root.select_one("p:not(.z)").text() == "onetwo"
    assert [n.text() for n in root.select('.z, p[title^="q"]')] == ["three", "four"]
    assert root.select_one("p[title*='/']").text() == "four"
    assert BY_NAME["clien"].base == "https://www.clien.net"


def test_details_are_asked_for_within_the_caps(spark):
    pages = spark.createDataFrame([(s, f"page of {s}", html) for s, (html, _) in PAGES.items()], "source string, url string, html string")
    got = E.detail_requests(E.candidates(pages)).collect()
    assert got and {r["source"] for r in got} <= {s.site for s in SITES if s.detail and s.enabled}
    per = {}
    for r in got:
        per[r["source"]] = per.get(r["source"], 0) + 1
    assert max(per.values()) <= 10
    links = [f"<tr><td class='subject'><a href='/view.php?no={i}'>a title {i}</a></td><td>1</td><td>2</td></tr>" for i in range(25)]
    many = spark.createDataFrame([("todayhumor", "p", "<table>" + "".join(links) + "</table>")], "source string, url string, html string")
    assert E.detail_requests(E.candidates(many)).count() == 10


def test_pages_found_later_are_fetched_and_failures_are_rows(spark, tmp_path):
    (tmp_path / "a").write_bytes("<p>가</p>".encode("cp949"))
    requests = [("slrclub", (tmp_path / "a").as_uri()), ("slrclub", (tmp_path / "none").as_uri())]
    got = decode_pages(fetch_pages(spark.createDataFrame(requests, "source string, url string"))).collect()
    assert sorted((r["html"], bool(r["error"])) for r in got if r["html"]) == [("<p>가</p>", False)]
    assert [bool(r["error"]) for r in got if r["html"] is None] == [True]
    errors = E.extraction_errors(spark.createDataFrame([("clien", "u", None, "timed out")], "source string, url string, html string, error string")).collect()
    assert [(r["source_site"], r["error"]) for r in errors] == [("clien", "timed out")]


def test_compressed_bodies():
    assert _plain(gzip.compress(b"x"), "gzip") == b"x" and _plain(zlib.compress(b"x"), "deflate") == b"x" and _plain(b"x", None) == b"x"
