"""What each site's list page looks like and how its entries become posts: data, no code.

Selectors, addresses and patterns are fixed values. A count rule is a name of functions/text.py
with where its raw text comes from; None is zero.
"""

from __future__ import annotations

import dataclasses

MOST = 30
ENRICHED = 10


@dataclasses.dataclass(frozen=True)
class Count:
    """A count: the parser to apply to a selected node's text, a cell's text, or the title's text."""

    parse: str = "to_count"
    select: str | None = None
    #: "cell:-1" counts cells from the end; "width:45" takes the last cell with that width.
    cell: str | None = None
    of_title: bool = False
    attr: str | None = None
    outside_title: bool = False


@dataclasses.dataclass(frozen=True)
class Site:
    site: str
    base: str
    list_url: str
    rows: str
    #: Containers that rows must lie in; the first match of each, in this order.
    within: tuple[str, ...] = ()
    title: tuple[str, ...] | None = None
    title_attr: bool = False
    strip_attr: bool = False
    title_without: str | None = None
    title_inside: str | None = None
    clean: tuple[str, ...] = ()
    least: int = 0
    link: str | None = None
    href_like: str | None = None
    url: str = "prefix"
    url_base: str | None = None
    scope: str = "row"
    cells: str = "td"
    upvotes: Count | None = None
    comments: Count | None = None
    views: Count | None = None
    image: str | None = None
    image_scheme: bool = False
    detail: str | None = None
    reject: tuple[str, ...] = ()
    detail_if_missing: bool = False
    key: str | None = None
    mark: str = "after"
    raw_limit: int | None = None
    limit: int | None = None
    charset: str | None = None
    enabled: bool = True


_TITLE = Count("first_bracket_count", of_title=True)

#: In the order of the registry; the last two are not registered.
SITES: list[Site] = [
    Site("clien", "https://www.clien.net", "/service/group/clien_all?&od=T33", ".list_item.symph_row", title=(".list_subject span.subject_fixed",), link="a.list_subject", upvotes=Count(select=".list_recommend"), comments=Count(select=".list_reply .rSymph"), views=Count(select=".list_hit"), image="img", raw_limit=MOST),
    Site("ruliweb", "https://bbs.ruliweb.com", "/best/board/300143", "tr.table_body.best", title=("a.deco",), upvotes=Count(select=".recomd"), comments=Count(select=".num_reply .num"), views=Count(select=".hit"), image="img", raw_limit=MOST),
    Site("ppomppu", "https://www.ppomppu.co.kr", "/hot.php", "tr.baseList, tr.bbs_new", title=("a.baseList-title, .baseList-title a, td.baseList-title a",), cells="td.board_date", upvotes=Count("rating_count", cell="cell:-2"), comments=Count(select="span.list_comment2"), views=Count(cell="cell:-1"), image="a.baseList-thumb img", image_scheme=True, raw_limit=MOST),
    Site("mlbpark", "https://mlbpark.donga.com", "/mp/best.php", 'a[href*="/mp/b.php?b="][href*="id="]', least=5, scope="parent", upvotes=Count(select=".like, .recom, .likeNum"), comments=Count(select=".replyNum, .reply"), views=Count(select=".hit, .viewNum"), key="title", limit=MOST, charset="utf-8"),
    Site("bobaedream", "https://www.bobaedream.co.kr", "/list?code=best", "a.bsubject", title_attr=True, least=1, scope="tr", upvotes=Count(select=".recom, .like, .recomm"), comments=Count(select=".replyCnt, .replyNum"), views=Count(select=".hit"), raw_limit=MOST, charset="detect"),
    Site("inven", "https://www.inven.co.kr", "https://hot.inven.co.kr/", 'a[href*="/board/"]', href_like=r"/board/\w+/\d+/\d+", clean=("without_rank",), least=4, comments=_TITLE, limit=MOST),
    Site("dcinside", "https://gall.dcinside.com", "/board/lists/?id=dcbest", "tr.ub-content", title=("td.gall_tit a:not(.reply_num)",), upvotes=Count("bracketed_count", select="td.gall_recommend"), comments=Count("bracketed_count", select="a.reply_num"), views=Count("bracketed_count", select="td.gall_count"), raw_limit=MOST),
    Site("humoruniv", "https://web.humoruniv.com", "/board/humor/board_best.html", 'a[href*="read.html"]', clean=("without_brackets", "without_recommend"), least=4, url_base="/board/humor/", scope="tr_or_li", upvotes=Count("recommend_count", of_title=True, attr="loose"), comments=_TITLE, image="img.thumb", image_scheme=True, raw_limit=MOST, charset="detect"),
    Site("82cook", "https://www.82cook.com", "", 'a[href*="read.php"]', within=("div.leftbox.Best ul.most",), title_attr=True, least=3, raw_limit=MOST),
    Site("theqoo", "https://theqoo.net", "/hot", "table tr", title=('a[href^="/hot/"]:not(.replyNum)',), href_like=r"^/hot/\d+\z", least=3, url="always", comments=Count(select="a.replyNum"), views=Count(cell="cell:-1"), detail="og", key="href", mark="before", limit=MOST),
    Site("slrclub", "https://www.slrclub.com", "/bbs/zboard.php?id=hot_article", 'a[href*="vx2.php"]', clean=("without_brackets",), least=4, scope="tr", comments=_TITLE, views=Count(cell="cell:-1"), detail="body", key="href", mark="before", limit=MOST, charset="detect"),
    Site("todayhumor", "https://www.todayhumor.co.kr", "/board/list.php?table=bestofbest", 'td.subject a[href*="view.php"]', least=3, scope="tr", upvotes=Count(cell="cell:-1"), views=Count(cell="cell:-2"), detail="og", reject=("test.png", "no_image"), raw_limit=MOST, charset="detect"),
    Site("etoland", "https://www.etoland.co.kr", "/bbs/hit.php", 'a[href*="wr_id="]', clean=("without_last_paren",), least=3, url="join", url_base="/bbs/hit.php", comments=Count("last_paren_count", of_title=True), detail="og", reject=("no_image", "test.png"), key="url", mark="before", raw_limit=2 * MOST, limit=MOST, charset="detect"),
    Site("instiz", "https://www.instiz.net", "/pt", "tr#detour", title=("td.listsubject a[href*='/pt/']",), title_inside="span.texthead_notice", title_without="span.cmt3", least=3, cells="td.listno", upvotes=Count(cell="width:25"), comments=Count("first_count", select="span.cmt3", attr="title", outside_title=True), views=Count(cell="width:45"), key="page", mark="before", limit=MOST),
    Site("ygosu", "https://ygosu.com", "/board/best_article/?type=daily&type2=group0", "tr", title=("td.tit",), title_inside="a[href*='/board/best_article/']", title_without="span.category, img, span.reply_cnt", least=3, comments=Count("first_count", select="span.reply_cnt", outside_title=True), key="page", mark="before", limit=MOST),
    Site("natepann", "https://pann.nate.com", "/", "a", within=("ol#talkerChoiceArea0", "ol#talkerChoiceArea1"), href_like=r"^/talk/\d+", title_attr=True, strip_attr=True, least=3, url="join", scope="li", upvotes=Count(select="span.count i"), detail="og", reject=("no_image",), key="url", mark="after", limit=40, charset="utf-8"),
    Site("fmkorea", "https://www.fmkorea.com", "/best", "li.li", title=("h3.title a", ".title a"), clean=("without_brackets",), least=4, url="id", upvotes=Count(select=".recomend_num, .recommend_num, .recom"), comments=Count(select=".comment_count, .replyNum"), views=Count(select=".hit, .view_count"), image="img", detail="og", detail_if_missing=True, key="title", mark="after", limit=MOST, enabled=False),
    Site("ddanzi", "https://www.ddanzi.com", "/free", 'a[href*="ddanzi.com/free/"]', least=5, url="verbatim", scope="tr_or_parent", upvotes=Count(select=".recom, .vote, .good"), comments=Count(select=".replyNum, .reply"), views=Count(select=".hit, .readedCount"), limit=MOST, enabled=False),
]
BY_NAME = {s.site: s for s in SITES}
REGISTRY = [s for s in SITES if s.enabled]

#: Request headers that a site adds to the usual ones.
EXTRA_HEADERS = {
    "fmkorea": {
        "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
        "Accept-Encoding": "gzip, deflate, br",
        "Referer": "https://www.fmkorea.com/",
        "Upgrade-Insecure-Requests": "1",
    }
}


def list_address(site: Site) -> str:
    return site.list_url if site.list_url.startswith("http") else site.base + site.list_url
