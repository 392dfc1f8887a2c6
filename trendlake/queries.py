"""Queries over the driver's tables, one or more for each operator, and the same in SQL.

`posts_view` makes posts of documents; anchors of pages stand for list entries. Both are
deterministic in either engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.noise import is_noise
from .functions.score import base_score, decay, hours_between, score
from .operators import dedup as D
from .operators import limits as L
from .operators import posts as P
from .operators.upsert import KeyedTable, upsert_keywords
from .plans.pipeline import process_posts, save_posts
from .session import checkpoint_dir
from .sources.extract import body_image, extract_posts, join_url, page_links
from .sources.keywords import danawa, daangn, daum, extract_keywords, namuwiki
from .sources.pages import decode_detected
from .sources.samples import DETAILS, PAGES
from .sources.sites import SITES

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts made of documents: the first line is the title, neighbours share a URL."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.expr("concat('https://x.example/', lang, '/', doc_id div 2)").alias("source_url"),
        F.col("source").alias("source_site"),
        (F.col("n_chars") % 97).alias("upvotes"),
        (F.col("n_chars") % 31).alias("comments"),
        F.col("n_chars").alias("views"),
        F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, 0, 17 * doc_id)").alias("created_at"),
    )


# RE2 knows neither (?U) nor Java's classes; these are the same sets of characters.
_STRIP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_POSTS = f"""
posts AS (
  SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, 'https://x.example/' || lang || '/' || (doc_id // 2) AS source_url, source AS source_site,
         n_chars % 97 AS upvotes, n_chars % 31 AS comments, n_chars AS views, TIMESTAMP '{AS_OF}' - to_minutes(17 * doc_id) AS created_at
  FROM documents
)"""
_TITLE_KEY = rf"lower(regexp_replace(title, '^{_STRIP}+|{_STRIP}+$', '', 'g'))"
_URL_KEPT = "url_kept AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY seq) = 1)"
_BOTH_KEPT = f"both_kept AS (SELECT * FROM url_kept QUALIFY row_number() OVER (PARTITION BY {_TITLE_KEY} ORDER BY seq) = 1)"
_NOISE_WORDS = "공지|안내|규칙|비밀번호|권장|필독|운영|관리자|점검|당첨|정책|\\[이벤트\\]|투표 참여|설문|\\[광고\\]|\\[홍보\\]|\\[협찬\\]|\\[PR\\]|\\[AD\\]|리딩방|단톡방|즉시입금|바로입금|당일입금|현금입금|무조건|선착순"


def _noise_sql(title: str) -> str:
    t = f"regexp_replace({title}, '^{_STRIP}+|{_STRIP}+$', '', 'g')"
    s = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
    return rf"""(length({t}) < 6 OR regexp_matches({t}, '{_NOISE_WORDS}') OR regexp_matches({t}, '(?i)^AD[^a-zA-Z ]') OR regexp_matches({t}, '(?i)#[^{s}]+.*#[^{s}]+') OR regexp_matches({t}, '[▶▼★◆◇■□●○]{{2,}}'))"""


def _score_sql(u: str, c: str, v: str, ts: str) -> str:
    h = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({ts})) / 1000000.0::DOUBLE / 3600.0::DOUBLE"
    steps = " ".join(f"WHEN {h} <= {b} THEN {s}::DOUBLE" for b, s in ((1, 1.0), (6, 0.7), (12, 0.4), (24, 0.2), (72, 0.08), (168, 0.03)))
    return f"CAST(format('{{:.2f}}', ({u} * 3 + {c} * 2 + {v} * 0.1::DOUBLE) * CASE {steps} ELSE 0.02::DOUBLE END) AS DOUBLE)"


@query(f"WITH {_POSTS}, {_URL_KEPT} SELECT seq, title, source_url FROM url_kept")
def dedup_url(spark, sf_dir):
    return D.dedup_by_url(posts_view(spark, sf_dir)).select("seq", "title", "source_url")


@query(f"WITH {_POSTS} SELECT seq, title, source_url FROM posts QUALIFY row_number() OVER (PARTITION BY {_TITLE_KEY} ORDER BY seq) = 1")
def dedup_title(spark, sf_dir):
    return D.dedup_by_title(posts_view(spark, sf_dir)).select("seq", "title", "source_url")


@query(f"WITH {_POSTS}, {_URL_KEPT}, {_BOTH_KEPT} SELECT seq, title, source_url FROM both_kept")
def dedup_chain(spark, sf_dir):
    return D.dedup(posts_view(spark, sf_dir)).select("seq", "title", "source_url")


@query(f"WITH {_POSTS} SELECT seq, title FROM posts WHERE NOT {_noise_sql('title')}")
def noise_filter(spark, sf_dir):
    return P.filter_notices(posts_view(spark, sf_dir)).select("seq", "title")


@query(f"WITH {_POSTS} SELECT seq, {_noise_sql('title')} AS noise FROM posts")
def noise_full_lists(spark, sf_dir):
    return posts_view(spark, sf_dir).select("seq", is_noise("title", folded=False).alias("noise"))


_EVENT_SCORE = _score_sql("floor(value)::BIGINT", "CAST(json_extract_string(props, '$.k') AS BIGINT)", "event_id", "ts")


def _scored_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"u": F.floor("value"), "c": F.get_json_object("props", "$.k").cast("bigint")})
    return e.withColumn("score", score(F.col("u"), F.col("c"), F.col("event_id"), F.col("ts"), as_of()))


@query(f"SELECT event_id, {_EVENT_SCORE} AS score FROM events")
def score_events(spark, sf_dir):
    return _scored_events(spark, sf_dir).select("event_id", "score")


@query(f"WITH s AS (SELECT event_id, {_EVENT_SCORE} AS score FROM events) SELECT event_id, score, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM s")
def score_rank(spark, sf_dir):
    return P.ranked(_scored_events(spark, sf_dir).select("event_id", "score"), seq="event_id").select("event_id", "score", "rank")


_HOURS = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1000000.0::DOUBLE / 3600.0::DOUBLE"


@query(f"""SELECT event_id, {_HOURS} AS hours, CASE WHEN {_HOURS} <= 1 THEN 1.0::DOUBLE WHEN {_HOURS} <= 6 THEN 0.7::DOUBLE WHEN {_HOURS} <= 12 THEN 0.4::DOUBLE WHEN {_HOURS} <= 24 THEN 0.2::DOUBLE
WHEN {_HOURS} <= 72 THEN 0.08::DOUBLE WHEN {_HOURS} <= 168 THEN 0.03::DOUBLE ELSE 0.02::DOUBLE END AS decay, floor(value)::BIGINT * 3 + event_id * 0.1::DOUBLE AS base FROM events""")
def decay_steps(spark, sf_dir):
    hours = hours_between(F.col("ts"), as_of())
    return table(spark, sf_dir, "events").select("event_id", hours.alias("hours"), decay(hours).alias("decay"), base_score(F.floor("value"), F.lit(0), F.col("event_id")).alias("base"))


_PIPELINE = f"""WITH {_POSTS}, {_URL_KEPT}, {_BOTH_KEPT}, scored AS (
SELECT seq, title, source_url, source_site, {_score_sql('upvotes', 'comments', 'views', 'created_at')} AS score FROM both_kept WHERE NOT {_noise_sql('title')})
SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM scored"""


@query(_PIPELINE)
def pipeline_posts(spark, sf_dir):
    done = process_posts(posts_view(spark, sf_dir), as_of())
    return P.ranked(done).select("seq", "title", "source_url", "source_site", "score", "rank")


def values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """Inline rows, the same as in the SQL beside."""
    text = ", ".join("(" + ", ".join("CAST(NULL AS STRING)" if v is None else _literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return str(v)


def values_sql(names: str, rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


ORDERED = [(0, "u0", "[PR] hello world"), (1, "u1", "[pr] hello world"), (2, "u0", "other title here"), (3, "u2", "Other Title here "), (4, "u3", "fresh title text")]


@query(f"""WITH posts AS (SELECT * FROM {values_sql('seq, source_url, title', ORDERED)}), {_URL_KEPT}, {_BOTH_KEPT}
SELECT CAST(seq AS BIGINT) AS seq, title FROM both_kept WHERE NOT {_noise_sql('title')}""")
def dedup_before_filter(spark, sf_dir):
    return P.filter_notices(D.dedup(values(spark, "seq, source_url, title", ORDERED))).select(F.col("seq").cast("bigint").alias("seq"), "title")


TITLES = [
    (i, t)
    for i, t in enumerate(
        ["공지 읽어주세요 모두", "[공지] 서버점검 안내", "이용규칙 변경 사항", "비밀번호 바꾸세요", "권장 사양 모음집", "필독 글입니다 여러분", "운영진 교체 소식", "관리자 모집합니다", "점검 시간 알림글", "이벤트 안내 드립니다", "당첨 후기 올립니다", "정책 변경 이야기", "[이벤트] 경품 드려요", "투표 참여 바랍니다", "설문 조사합니다요", "[광고] 싸게 팝니다", "[홍보] 내 채널입니다", "[협찬] 받은 제품기", "[PR] hello world", "[pr] hello world", "[AD] buy this now", "[ad] buy this now", "리딩방 들어오세요", "단톡방 주소 공유", "즉시입금 해드려요", "바로입금 가능하다", "당일입금 됩니다요", "현금입금 확인요망", "무조건 이득 보는법", "선착순 백명 모집함",
         "AD갤럭시 특가 판매", "AD phone is here", "ad갤럭시 특가 판매", "ADVENTURE time now", "#one and #two tags", "#one tag alone here", "★★ big news today", "★ small news today", "12345", "123456", " 12345 ", "\u3000abcde\u00a0", "abcdef", "평범한 제목입니다", "그냥 보통 이야기글", "", "ordinary english title"]
    )
]


@query(f"SELECT CAST(seq AS BIGINT) AS seq, {_noise_sql('title')} AS noise FROM {values_sql('seq, title', TITLES)}")
def noise_titles(spark, sf_dir):
    return values(spark, "seq, title", TITLES).select(F.col("seq").cast("bigint").alias("seq"), is_noise("title").alias("noise"))


_A = r"""<a [^>]*?href="([^"]*)"[^>]*>([^<]*)</a>"""
_ANCHORS = f"""
anchors AS (
  SELECT page_id, url, unnest(range(0, len(hrefs))) AS pos, hrefs, texts FROM (
    SELECT page_id, url, regexp_extract_all(html, '{_A}', 1) AS hrefs, regexp_extract_all(html, '{_A}', 2) AS texts FROM pages)
), a AS (SELECT page_id, url, CAST(pos AS BIGINT) AS pos, hrefs[pos + 1] AS href, regexp_replace(texts[pos + 1], '^{_STRIP}+|{_STRIP}+$', '', 'g') AS text FROM anchors)"""


def anchors_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(_A), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(_A), F.lit(2)).alias("text"))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), F.col("a.href").alias("href"), T.strip("a.text").alias("text"))


@query(f"WITH {_ANCHORS} SELECT page_id, pos, href, text FROM a")
def anchors(spark, sf_dir):
    return anchors_view(spark, sf_dir).select("page_id", "pos", "href", "text")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


HREFS = [(i, h) for i, h in enumerate(["https://a.example/x", "http://b.example", "/x/y", "x.php?no=1", "../up", "//h.example/z.png", "?a=1", "#frag", "", "/v?document_srl=77&x=1", "index.php?mid=best&document_srl=123456", "/p?x=1#f", "/p#f?x", None])]
_ABS = "CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://s.example' || href END"
_HREFS = values_sql("i, href", HREFS)


@query(f"SELECT CAST(i AS BIGINT) AS i, {_ABS} AS url FROM {_HREFS}")
def url_abs(spark, sf_dir):
    return values(spark, "i, href", HREFS).select(F.col("i").cast("bigint").alias("i"), T.absolute("https://s.example", "href").alias("url"))


@query(f"WITH {_ANCHORS} SELECT page_id, pos, regexp_replace({_ABS}, '\\?.*', '') AS url_key FROM a")
def url_key(spark, sf_dir):
    return anchors_view(spark, sf_dir).select("page_id", "pos", T.without_query(T.absolute("https://s.example", "href")).alias("url_key"))


@query(f"SELECT CAST(i AS BIGINT) AS i, nullif(CASE WHEN starts_with(href, '//') THEN 'https:' || href ELSE href END, '') AS url FROM {_HREFS}")
def scheme_fix(spark, sf_dir):
    return values(spark, "i, href", HREFS).select(F.col("i").cast("bigint").alias("i"), T.with_scheme("href").alias("url"))


@query(f"SELECT CAST(i AS BIGINT) AS i, CASE WHEN regexp_extract(href, 'document_srl=(\\d+)', 1) <> '' THEN 'https://s.example/' || regexp_extract(href, 'document_srl=(\\d+)', 1) ELSE {_ABS} END AS url FROM {_HREFS}")
def id_url(spark, sf_dir):
    return values(spark, "i, href", HREFS).select(F.col("i").cast("bigint").alias("i"), T.url_by_id("https://s.example", "href").alias("url"))


COUNTS = [(i, c) for i, c in enumerate(["1,234", "[12]", "[12/3]", "1.5", "12 - 3", "-3", "", None, " 7 ", "3000000000", "12-3", "+7", "abc", "[1,024]", "9,99,9", "0", "추천 +15 [3]", "t [3] [4]", "t (12)", "1t [2]", "답글추천 +9", "유효 댓글 수 41", "x (5) y"])]
_COUNTS = values_sql("i, raw", COUNTS)


def _int_sql(x: str) -> str:
    plain = rf"replace(regexp_replace({x}, '^{_STRIP}+|{_STRIP}+$', '', 'g'), ',', '')"
    return f"coalesce(CASE WHEN regexp_full_match({plain}, '[+-]?[0-9]+') THEN try_cast({plain} AS BIGINT) END, 0)"


def _found_sql(pattern: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(raw, '{pattern}', 1), '') AS BIGINT), 0)"


_UNBRACKETED = r"regexp_replace(trim(raw), '^[\[\]]+|[\[\]]+$', '', 'g')"


@query(rf"""SELECT CAST(i AS BIGINT) AS i, {_int_sql('raw')} AS plain, {_int_sql(_UNBRACKETED)} AS bracketed, {_int_sql("split_part(raw, '-', 1)")} AS rating,
{_found_sql(r'\[(\d+)\]')} AS first_bracket, {_found_sql(r'\((\d+)\)\s*$')} AS last_paren, {_found_sql(r'추천\s*\+(\d+)')} AS recommend, {_found_sql(r'(\d+)')} AS first_number FROM {_COUNTS}""")
def count_parse(spark, sf_dir):
    rules = {"plain": T.to_count, "bracketed": T.bracketed_count, "rating": T.rating_count, "first_bracket": T.first_bracket_count, "last_paren": T.last_paren_count, "recommend": T.recommend_count, "first_number": T.first_count}
    return values(spark, "i, raw", COUNTS).select(F.col("i").cast("bigint").alias("i"), *[f("raw").alias(n) for n, f in rules.items()])


@query(rf"""SELECT CAST(i AS BIGINT) AS i, trim(regexp_replace(raw, '\[\d+\]', '', 'g')) AS no_brackets, trim(regexp_replace(raw, '\s*\(\d+\)\s*$', '')) AS no_paren,
trim(regexp_replace(raw, '^\d+', '')) AS no_rank, trim(regexp_replace(raw, '답글추천\s*\+\d+', '', 'g')) AS no_recommend FROM {_COUNTS}""")
def title_clean(spark, sf_dir):
    rules = {"no_brackets": T.without_brackets, "no_paren": T.without_last_paren, "no_rank": T.without_rank, "no_recommend": T.without_recommend}
    return values(spark, "i, raw", COUNTS).select(F.col("i").cast("bigint").alias("i"), *[f("raw").alias(n) for n, f in rules.items()])


OG = [(i, h) for i, h in enumerate(['<meta property="og:image" content="https://i.example/a.jpg">', "<META content='https://i.example/b.jpg' property='og:image' />", '<meta property="og:title" content="x">', '<meta name="v"><meta property="og:image" content="https://i.example/no_image.png">', '<meta content="https://i.example/test.png" property="og:image"><meta property="og:image" content="late.jpg">', "", None])]


@query(rf"""WITH o AS (SELECT i, html, coalesce(nullif(regexp_extract(html, $$(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']|<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']$$, 1), ''),
nullif(regexp_extract(html, $$(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']|<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']$$, 2), '')) AS image FROM {values_sql('i, html', OG)})
SELECT CAST(i AS BIGINT) AS i, image, CASE WHEN NOT contains(image, 'no_image') AND NOT contains(image, 'test.png') THEN image END AS accepted FROM o""")
def og_image(spark, sf_dir):
    image = T.og_image("html")
    return values(spark, "i, html", OG).select(F.col("i").cast("bigint").alias("i"), image.alias("image"), T.unless_contains(image, ["no_image", "test.png"]).alias("accepted"))


BODIES = [(i, h) for i, h in enumerate(['<img src="//media.slrclub.com/1.gif"><img src="//media.slrclub.com/2.jpg">', '<img src="https://media.slrclub.com/3.PNG">', '<img src="https://other.example/4.jpg"><img alt="x" src="https://media.slrclub.com/5.jpeg">', "<p>none</p>"])]


@query(f"""WITH s AS (SELECT i, unnest(regexp_extract_all(html, '<img[^>]*? src="([^"]*)"', 1)) AS src, generate_subscripts(regexp_extract_all(html, '<img[^>]*? src="([^"]*)"', 1), 1) AS k FROM {values_sql('i, html', BODIES)}),
g AS (SELECT i, src FROM s WHERE contains(src, 'media.slrclub.com') AND NOT ends_with(lower(src), '.gif') AND NOT ends_with(lower(src), '.png') QUALIFY row_number() OVER (PARTITION BY i ORDER BY k) = 1)
SELECT CAST(b.i AS BIGINT) AS i, CASE WHEN starts_with(src, '//') THEN 'https:' || src ELSE src END AS image FROM (SELECT i FROM {values_sql('i, html', BODIES)}) b LEFT JOIN g ON b.i = g.i""")
def detail_image(spark, sf_dir):
    return values(spark, "i, html", BODIES).select(F.col("i").cast("bigint").alias("i"), body_image("html").alias("image"))


_VALID, _VALID_SQL = "length(text) >= 3", "length(text) >= 3"


@query(f"WITH {_ANCHORS} SELECT page_id, pos, text FROM a WHERE pos < 5 AND {_VALID_SQL}")
def prefix_limit(spark, sf_dir):
    return L.prefix_limit(anchors_view(spark, sf_dir), F.expr(_VALID), ["page_id"], "pos", 5).select("page_id", "pos", "text")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, text FROM a WHERE {_VALID_SQL} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3")
def valid_limit(spark, sf_dir):
    return L.valid_limit(anchors_view(spark, sf_dir), F.expr(_VALID), ["page_id"], "pos", 3).select("page_id", "pos", "text")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, text FROM a WHERE pos < 4 AND {_VALID_SQL} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2")
def both_limit(spark, sf_dir):
    return L.both_limit(anchors_view(spark, sf_dir), F.expr(_VALID), ["page_id"], "pos", 4, 2).select("page_id", "pos", "text")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, CASE WHEN row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2 THEN 'img:' || href END AS image_url FROM a")
def enrich_cap(spark, sf_dir):
    rows = anchors_view(spark, sf_dir)
    return L.enrich_cap(rows, ["page_id"], "pos", F.concat(F.lit("img:"), "href"), 2).select("page_id", "pos", "image_url")


@query(f"""WITH {_ANCHORS}, h AS (SELECT *, CASE WHEN length(text) % 2 = 0 THEN text END AS have FROM a)
SELECT page_id, pos, CASE WHEN have IS NOT NULL AND have <> '' THEN have WHEN sum(CASE WHEN have IS NULL OR have = '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) <= 2 THEN 'img:' || href ELSE have END AS image_url FROM h""")
def enrich_cap_conditional(spark, sf_dir):
    rows = anchors_view(spark, sf_dir)
    return L.enrich_missing(rows, ["page_id"], "pos", F.expr("CASE WHEN length(text) % 2 = 0 THEN text END"), F.concat(F.lit("img:"), "href"), 2).select("page_id", "pos", "image_url")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, href, text FROM a QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1 AND {_VALID_SQL}")
def mark_before(spark, sf_dir):
    rows = anchors_view(spark, sf_dir).withColumn("seq", F.shiftleft(F.col("page_id"), 32) + F.col("pos"))
    return D.first_marked_before(rows, F.expr(_VALID), F.col("href")).select("page_id", "pos", "href", "text")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, href, text FROM a WHERE {_VALID_SQL} QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1")
def mark_after(spark, sf_dir):
    rows = anchors_view(spark, sf_dir).withColumn("seq", F.shiftleft(F.col("page_id"), 32) + F.col("pos"))
    return D.first_marked_after(rows, F.expr(_VALID), F.col("href")).select("page_id", "pos", "href", "text")


DAUM = [(0, "none"), (1, 'x list_trend <i data-keyword="하나"></i><i data-keyword="a b"></i></ul> <i data-keyword="no"></i>'), (2, 'list_trend <i data-keyword="first"></i> list_trend <i data-keyword="second"></i></ul>'), (3, 'list_trend <i data-keyword="first"></i>list_trend'), (4, "list_trend" + "".join(f'<i data-keyword="k{i}"></i>' for i in range(12)))]


def _flat(rows: DataFrame, found: Column, error: Column) -> DataFrame:
    listed = rows.select(F.col("i").cast("bigint").alias("i"), F.when(error.isNull(), found).alias("found"))
    return listed.select("i", F.posexplode("found").alias("pos", "item")).select("i", F.col("pos").cast("bigint").alias("pos"), F.col("item.keyword").alias("keyword"), F.col("item.url").alias("url"))


_QUOTE = "replace(url_encode({}), '%2F', '/')"


@query(f"""WITH p AS (SELECT i, string_split(html, 'list_trend') AS parts FROM {values_sql('i, html', DAUM)}),
s AS (SELECT i, CASE WHEN len(parts) > 2 THEN parts[3] WHEN len(parts) > 1 THEN parts[2] ELSE '' END AS section FROM p),
k AS (SELECT i, list_slice(regexp_extract_all(split_part(section, '</ul>', 1), 'data-keyword="([^"]+)"', 1), 1, 10) AS words FROM s WHERE section <> ''),
u AS (SELECT i, unnest(range(0, len(words))) AS pos, words FROM k)
SELECT CAST(i AS BIGINT) AS i, CAST(pos AS BIGINT) AS pos, words[pos + 1] AS keyword, 'https://search.daum.net/search?q=' || {_QUOTE.format('words[pos + 1]')} AS url FROM u""")
def kw_split(spark, sf_dir):
    return _flat(values(spark, "i, html", DAUM), *daum(F.col("html")))


DANAWA = [(0, "none"), (1, 'hot_keyword <a href="/dsearch.php?query=%41" target="_self" title="그래픽 카드"><a href="/dsearch.php?query=b" target="_self" title="hot_keyword"></dl><a href="/dsearch.php?query=c" target="_self" title="late">')]


@query(f"""WITH s AS (SELECT i, split_part(substr(html, strpos(html, 'hot_keyword') + 11), '</dl>', 1) AS section FROM {values_sql('i, html', DANAWA)} WHERE contains(html, 'hot_keyword')),
k AS (SELECT i, list_slice(regexp_extract_all(section, '<a href="/dsearch\\.php\\?query=[^"]*" target="_self" title="([^"]+)">', 1), 1, 10) AS words FROM s), u AS (SELECT i, unnest(range(0, len(words))) AS pos, words FROM k)
SELECT CAST(i AS BIGINT) AS i, CAST(pos AS BIGINT) AS pos, words[pos + 1] AS keyword, 'https://search.danawa.com/dsearch.php?query=' || {_QUOTE.format('words[pos + 1]')} AS url FROM u""")
def kw_regex(spark, sf_dir):
    return _flat(values(spark, "i, html", DANAWA), *danawa(F.col("html")))


_LINK = '<a href="/kr/buy-sell/s/?search={}" class="x"> {} </a>'
DAANGN = [(0, "none"), (1, _LINK.format("%EC%9E%90", "bike") + _LINK.format("b", "bike") + _LINK.format("c+d", "two words") + _LINK.format("%41%2F", "slash")), (2, "".join(_LINK.format(f"k{i % 12}", f"t{i % 12}") for i in range(20)))]


@query(f"""WITH p AS (SELECT i, regexp_extract_all(html, $$href="/kr/buy-sell/s/\\?search=([^"&]+)"[^>]*>\\s*([^<]+?)\\s*<$$, 1) AS raws, regexp_extract_all(html, $$href="/kr/buy-sell/s/\\?search=([^"&]+)"[^>]*>\\s*([^<]+?)\\s*<$$, 2) AS texts FROM {values_sql('i, html', DAANGN)}),
u AS (SELECT i, unnest(range(0, len(raws))) AS k, raws, texts FROM p), f AS (SELECT i, k, raws[k + 1] AS raw FROM u WHERE trim(texts[k + 1]) <> '' QUALIFY row_number() OVER (PARTITION BY i, trim(texts[k + 1]) ORDER BY k) = 1),
n AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY k) - 1 AS pos, url_decode(raw) AS keyword FROM f)
SELECT CAST(i AS BIGINT) AS i, CAST(pos AS BIGINT) AS pos, keyword, 'https://www.daangn.com/kr/buy-sell/s/?search=' || {_QUOTE.format('keyword')} AS url FROM n WHERE pos < 10""")
def kw_dedup(spark, sf_dir):
    return _flat(values(spark, "i, html", DAANGN), *daangn(F.col("html")))


NAMU = [(0, "none"), (1, '{"a":[{"type":"WikiRank","no":1,"keyword":"나무","url":"//namu.wiki/w/1"},{"type":"WikiRank","no":2,"keyword":"b c","url":"https://namu.wiki/w/2"}]}'), (2, "".join(f'"WikiRank","no":{i},"keyword":"k{i}","url":"/w/{i}" ' for i in range(12)))]


@query(f"""WITH p AS (SELECT i, regexp_extract_all(html, '"WikiRank","no":\\d+,"keyword":"([^"]+)","url":"([^"]+)"', 1) AS words, regexp_extract_all(html, '"WikiRank","no":\\d+,"keyword":"([^"]+)","url":"([^"]+)"', 2) AS raws FROM {values_sql('i, html', NAMU)}),
u AS (SELECT i, unnest(range(0, len(words))) AS pos, words, raws FROM p)
SELECT CAST(i AS BIGINT) AS i, CAST(pos AS BIGINT) AS pos, words[pos + 1] AS keyword, CASE WHEN starts_with(raws[pos + 1], '//') THEN 'https:' || raws[pos + 1] ELSE raws[pos + 1] END AS url FROM u WHERE pos < 10""")
def kw_json(spark, sf_dir):
    return _flat(values(spark, "i, html", NAMU), *namuwiki(F.col("html")))


@query(f"""WITH {_ANCHORS}, k AS (SELECT * FROM a WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 10)
SELECT page_id, count(*) AS n, string_agg(text || '=' || href, ';' ORDER BY pos) AS keywords FROM k GROUP BY page_id""")
def kw_cache(spark, sf_dir):
    few = L.first_rows(anchors_view(spark, sf_dir).filter("text <> ''"), ["page_id"], "pos", 10)  # so lists have ten items at most
    lists = few.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("text", F.lit("="), "href").alias("item")))).alias("items"))
    return lists.select("page_id", F.size("items").cast("bigint").alias("n"), F.array_join("items.item", ";").alias("keywords"))


@query("SELECT doc_id, source, CAST(CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END AS BIGINT) * 1099511627776 + doc_id AS seq FROM documents")
def union_sources(spark, sf_dir):
    """Three sources by name, and one of all others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    named = [docs.filter(F.col("source") == f"src{i}") for i in range(3)]
    rest = docs.filter(F.col("source").isNull() | ~F.col("source").isin("src0", "src1", "src2"))
    return P.union_sources([*named, rest], pos="doc_id").select("doc_id", "source", "seq")


def new_table(spark: SparkSession, name: str, key: str) -> KeyedTable:
    return KeyedTable(spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", key)


@query(f"""WITH {_POSTS}, b AS (SELECT 0 AS batch, seq, source_url, title, views FROM posts UNION ALL SELECT 1, seq, source_url, 'new ' || title, views + 1 FROM posts WHERE views > 1000)
SELECT source_url, title, views FROM b QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY batch DESC, seq DESC) = 1""")
def upsert_posts(spark, sf_dir):
    """All posts into a table, changed ones again, and a batch of none; then compacted and read."""
    posts = posts_view(spark, sf_dir).select("seq", "source_url", "title", "views")
    changed = posts.filter("views > 1000").withColumns({"title": F.concat(F.lit("new "), "title"), "views": F.col("views") + 1})
    stored = new_table(spark, "upsert_posts", "source_url")
    for batch in (posts, changed, changed.filter("views < 0")):
        stored.upsert(batch, F.col("seq"))
    stored.compact()
    return stored.read().select("source_url", "title", "views")


@query(f"""WITH {_ANCHORS}, k AS (SELECT * FROM a WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= CASE WHEN starts_with(url, 'https') THEN 1 ELSE 10 END)
SELECT page_id, count(*) AS n, string_agg(text || '=' || href, ';' ORDER BY pos) AS keywords FROM k GROUP BY page_id""")
def keyword_table(spark, sf_dir):
    """The list of each page into the keyword table; then shorter lists of some, and empty lists, which change nothing."""
    few = L.first_rows(anchors_view(spark, sf_dir).filter("text <> ''"), ["page_id"], "pos", 10)  # so lists have ten items at most
    lists = few.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("text").alias("keyword"), F.col("href").alias("to")))).alias("items"))
    found = lists.select(F.col("page_id").alias("source"), "url", F.transform("items", lambda x: F.struct(x["keyword"].alias("keyword"), x["to"].alias("url"))).alias("keywords"))
    stored = new_table(spark, "keyword_table", "source")
    upsert_keywords(stored, found, as_of())
    upsert_keywords(stored, found.withColumn("keywords", F.slice("keywords", 1, F.when(F.startswith("url", F.lit("https")), 1).otherwise(0))), as_of())
    joined = F.array_join(F.transform("keywords", lambda k: F.concat(k["keyword"], F.lit("="), k["url"])), ";")
    return stored.read().select(F.col("source").alias("page_id"), F.size("keywords").cast("bigint").alias("n"), joined.alias("keywords"))


@query(f"""WITH {_POSTS}, {_URL_KEPT}, {_BOTH_KEPT}, kept AS (SELECT * FROM both_kept WHERE NOT {_noise_sql('title')})
SELECT 'collected' AS stage, count(*) AS rows FROM posts UNION ALL SELECT 'deduplicated', count(*) FROM both_kept UNION ALL SELECT 'kept', count(*) FROM kept UNION ALL SELECT 'saved', count(DISTINCT source_url) FROM kept""")
def run_report(spark, sf_dir):
    """The stage counts of a run that writes all posts."""
    posts = posts_view(spark, sf_dir).withColumns({"content": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string")})
    report = save_posts(posts, new_table(spark, "run_report", "source_url"), as_of())
    return spark.createDataFrame([(stage, getattr(report, stage)) for stage in ("collected", "deduplicated", "kept", "saved")], "stage string, rows long")


_KEYWORD_URLS = f"CASE source WHEN 'danawa' THEN 'https://search.danawa.com/dsearch.php?query=' || {_QUOTE.format('text')} WHEN 'daum' THEN 'https://search.daum.net/search?q=' || {_QUOTE.format('text')} WHEN 'daangn' THEN 'https://www.daangn.com/kr/buy-sell/s/?search=' || {_QUOTE.format('text')} ELSE 'https://n.example' || href END"


@query(f"""WITH {_ANCHORS}, t AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS again FROM a WHERE text <> ''),
s AS (SELECT t.*, source FROM t, (SELECT unnest(['danawa', 'daum', 'daangn', 'namuwiki']) AS source) WHERE source <> 'daangn' OR again = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, source ORDER BY pos) - 1 AS place FROM s)
SELECT page_id, source, CAST(place AS BIGINT) AS pos, text AS keyword, {_KEYWORD_URLS} AS url FROM n WHERE place < 10""")
def keyword_pages(spark, sf_dir):
    """A page of each keyword source made of every page's links, and what is extracted from it."""
    listed = anchors_view(spark, sf_dir).filter("text <> ''").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "href"))).alias("items"))
    each = lambda make: F.array_join(F.transform("items", make), "")
    pages = {
        "danawa": F.concat(F.lit("hot_keyword"), each(lambda x: F.concat(F.lit('<a href="/dsearch.php?query=x" target="_self" title="'), x["text"], F.lit('">'))), F.lit("</dl>")),
        "daum": F.concat(F.lit("list_trend"), each(lambda x: F.concat(F.lit('<i data-keyword="'), x["text"], F.lit('"></i>'))), F.lit("</ul>")),
        "daangn": each(lambda x: F.concat(F.lit('<a href="/kr/buy-sell/s/?search='), T.quote(x["text"]), F.lit('" class="x"> '), x["text"], F.lit(" </a>"))),
        "namuwiki": each(lambda x: F.concat(F.lit('"WikiRank","no":'), x["pos"].cast("string"), F.lit(',"keyword":"'), x["text"], F.lit('","url":"//n.example'), x["href"], F.lit('"'))),
    }
    made = listed.select("page_id", F.inline(F.array(*[F.struct(F.lit(name).alias("source"), html.alias("html")) for name, html in pages.items()])))
    found = extract_keywords(made, "page_id")
    return found.select("page_id", "source", F.posexplode("keywords").alias("pos", "k")).select("page_id", "source", F.col("pos").cast("bigint").alias("pos"), F.col("k.keyword").alias("keyword"), F.col("k.url").alias("url"))


@query(f"""WITH {_ANCHORS} SELECT page_id, pos, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://s.example' || href END AS absolute, 'https://h.example' || href AS with_scheme, 'https://s.example/' || page_id AS by_id FROM a""")
def url_rules(spark, sf_dir):
    rows = anchors_view(spark, sf_dir).withColumns({"bare": F.concat(F.lit("//h.example"), "href"), "numbered": F.concat("href", F.lit("?document_srl="), F.col("page_id").cast("string"))})
    return rows.select("page_id", "pos", T.absolute("https://s.example", "href").alias("absolute"), T.with_scheme("bare").alias("with_scheme"), T.url_by_id("https://s.example", "numbered").alias("by_id"))


@query("""SELECT doc_id, n_chars AS plain, n_chars AS bracketed, n_chars AS rating, n_chars AS first_bracket, doc_id AS last_paren, n_chars AS recommend, CAST(n_chars // 7 AS BIGINT) AS first_number FROM documents""")
def count_rules(spark, sf_dir):
    """Each way of writing a count, with the counts of all documents."""
    n, d = F.format_number("n_chars", 0), F.col("doc_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    plain = F.col("n_chars").cast("string")
    found = {
        "plain": T.to_count(text(" ", n, " ")),
        "bracketed": T.bracketed_count(text("[", plain, "]")),
        "rating": T.rating_count(text(plain, " - ", d)),
        "first_bracket": T.first_bracket_count(text("t [", plain, "] [", d, "]")),
        "last_paren": T.last_paren_count(text("t (", plain, ") (", d, ")")),
        "recommend": T.recommend_count(text("추천 +", plain)),
        "first_number": T.first_count(text("x", F.floor(F.col("n_chars") / 7).cast("string"), "y", d)),
    }
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()])


@query(f"""WITH {_POSTS}, t AS (SELECT seq, 'x' || title || 'x' AS t FROM posts) SELECT seq, t AS no_brackets, t AS no_paren, t AS no_rank, t AS no_recommend FROM t""")
def title_rules(spark, sf_dir):
    """Titles of all documents with what the pages of sites add to them, and without it again."""
    t, n = F.concat(F.lit("x"), "title", F.lit("x")), F.col("seq").cast("string")
    rows = posts_view(spark, sf_dir)
    cleaned = {
        "no_brackets": T.without_brackets(F.concat(t, F.lit(" ["), n, F.lit("] "))),
        "no_paren": T.without_last_paren(F.concat(t, F.lit(" ("), n, F.lit(") "))),
        "no_rank": T.without_rank(F.concat(n, F.lit(" "), t)),
        "no_recommend": T.without_recommend(F.concat(t, F.lit(" 답글추천 +"), n)),
    }
    return rows.select("seq", *[c.alias(k) for k, c in cleaned.items()])


@query("SELECT page_id, url AS property_first, url AS content_first, CASE WHEN NOT contains(url, 'example.net') THEN url END AS accepted, 'https://media.slrclub.com/' || page_id || '.jpg' AS in_body FROM pages")
def picture_rules(spark, sf_dir):
    """Pictures named in every page's head, in both orders of attributes, and in its body."""
    n = F.col("page_id").cast("string")
    first = F.concat(F.lit('<meta property="og:image" content="'), "url", F.lit('">'), "html")
    second = F.concat(F.lit("<META content='"), "url", F.lit("' property='og:image' />"), "html")
    body = F.concat("html", F.lit('<img src="//media.slrclub.com/'), n, F.lit('.gif"><img alt="x" src="//media.slrclub.com/'), n, F.lit('.jpg">'))
    return table(spark, sf_dir, "pages").select("page_id", T.og_image(first).alias("property_first"), T.og_image(second).alias("content_first"), T.unless_contains(T.og_image(first), ["example.net"]).alias("accepted"), body_image(body).alias("in_body"))


@query(f"WITH {_POSTS} SELECT seq, {_QUOTE.format('title')} AS quoted, title AS again FROM posts")
def percent_rules(spark, sf_dir):
    return posts_view(spark, sf_dir).select("seq", T.quote("title").alias("quoted"), T.unquote(T.quote("title")).alias("again"))


_SITES = ", ".join(f"('{s}', '{P.SITE_NAMES[s]}', '{P.SITE_COLORS[s]}')" for s in P.SITE_NAMES)


@query(f"""WITH s(n, site, name, color) AS (SELECT row_number() OVER () - 1, * FROM (VALUES {_SITES}, ('other', NULL, NULL))), d AS (SELECT doc_id, list_extract((SELECT list(site ORDER BY n) FROM s), CAST(doc_id % 16 AS INT) + 1) AS source_site FROM documents)
SELECT doc_id, source_site, name AS site_name, color AS site_color FROM d JOIN s ON d.source_site = s.site""")
def site_lookup(spark, sf_dir):
    sites = F.array(*map(F.lit, [*P.SITE_NAMES, "other"]))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(sites, (F.col("doc_id") % 16).cast("int")).alias("source_site"))
    return P.with_site_labels(rows).select("doc_id", "source_site", "site_name", "site_color")


QUOTED = [(i, t) for i, t in enumerate(["a b", "a/b", "a+b", "100%", "~-._", "가나 다", "x&y=z?", "(*)!'", ""])]


@query(f"SELECT CAST(i AS BIGINT) AS i, {_QUOTE.format('t')} AS quoted FROM {values_sql('i, t', QUOTED)}")
def percent_quote(spark, sf_dir):
    return values(spark, "i, t", QUOTED).select(F.col("i").cast("bigint").alias("i"), T.quote("t").alias("quoted"))


ESCAPED = [(i, t) for i, t in enumerate(["a%20b", "a+b", "%EA%B0%80", "plain", ""])]


@query(f"SELECT CAST(i AS BIGINT) AS i, url_decode(t) AS plain FROM {values_sql('i, t', ESCAPED)}")
def percent_unquote(spark, sf_dir):
    return values(spark, "i, t", ESCAPED).select(F.col("i").cast("bigint").alias("i"), T.unquote("t").alias("plain"))


@query(f"WITH {_ANCHORS} SELECT page_id, pos, href, text FROM a")
def html_udtf_anchors(spark, sf_dir):
    return page_links(table(spark, sf_dir, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


# All links of the pages begin with one slash, so that the target is the page's origin and the link.
@query(f"WITH {_ANCHORS} SELECT page_id, pos, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS target FROM a")
def urljoin(spark, sf_dir):
    return anchors_view(spark, sf_dir).select("page_id", "pos", join_url("url", "href").alias("target"))


@query("SELECT page_id, html FROM pages")
def decode_bytes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", decode_detected(F.encode("html", "UTF-8")).alias("html"))


@query(r"""SELECT page_id, '<meta charset="euc-kr">' || regexp_replace(html, '[^\x00-\x7F]', '', 'g') || '가나다' AS html FROM pages""")
def decode_legacy(spark, sf_dir):
    """Pages as bytes of a charset that they name themselves."""
    plain = F.concat(F.lit('<meta charset="euc-kr">'), F.regexp_replace("html", r"[^\x00-\x7F]", ""))
    body = F.concat(F.encode(plain, "UTF-8"), F.unhex(F.lit("B0A1B3AAB4D9")))
    return table(spark, sf_dir, "pages").select("page_id", decode_detected(body).alias("html"))


_EXTRACTED = [(rank, s.site, place, *post) for rank, s in enumerate(SITES) for place, post in enumerate(PAGES[s.site][1])]


@query(f"SELECT CAST(site_rank AS INTEGER) AS site_rank, source_site, CAST(place AS BIGINT) AS place, title, source_url, CAST(upvotes AS BIGINT) AS upvotes, CAST(comments AS BIGINT) AS comments, CAST(views AS BIGINT) AS views, image_url FROM {values_sql('site_rank, source_site, place, title, source_url, upvotes, comments, views, image_url', _EXTRACTED)}")
def extract_sites(spark, sf_dir):
    """The sample page of each site; its SQL is the posts that should come out."""
    pages = spark.createDataFrame([(s, f"page of {s}", html) for s, (html, _) in PAGES.items()], "source string, url string, html string")
    posts = extract_posts(pages, as_of(), spark.createDataFrame(DETAILS, "url string, html string"), SITES)
    first = posts.groupBy("source_site").agg(F.min("seq").alias("_first"), F.collect_set("seq").alias("_all"))
    place = F.size(F.filter("_all", lambda x: x < F.col("seq"))).cast("bigint")  # a handful a page
    return posts.join(first, "source_site").select("site_rank", "source_site", place.alias("place"), "title", "source_url", "upvotes", "comments", "views", "image_url")
