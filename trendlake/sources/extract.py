"""From list pages to posts, as the site specs say.

The tree walk is the one step in Python, batch-wise over pages; it only picks nodes. Cleaning,
URL rules, dedup within the source, limits and enrichment are DataFrame operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.posts import with_seq
from .html_tree import Node, parse
from .sites import BY_NAME, ENRICHED, REGISTRY, Count, Site

CANDIDATES = "site_rank int, source_site string, page string, pos int, has_title boolean, href string, text string, loose_text string, title_attr string, upvotes_raw string, comments_raw string, views_raw string, image_raw string, error string"
_ARROW = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[k]) for n, k in (c.split(" ") for c in CANDIDATES.split(", "))])


def _row_nodes(site: Site, root: Node) -> list[Node]:
    if not site.within:
        return root.select(site.rows)
    found = (root.select_one(w) for w in site.within)
    nodes = [n for box in found if box is not None for n in box.select(site.rows)]
    return [n for n in nodes if re.search(site.href_like, n.attrs.get("href", ""))] if site.href_like else nodes


def _scope(site: Site, row: Node) -> Node | None:
    nearest = {"row": lambda: row, "parent": lambda: row.parent, "tr": lambda: row.ancestor("tr"), "li": lambda: row.ancestor("li"), "tr_or_li": lambda: row.ancestor("tr", "li"), "tr_or_parent": lambda: row.ancestor("tr") or row.parent}
    return nearest[site.scope]()


def _title_nodes(site: Site, row: Node) -> tuple[Node | None, Node | None]:
    """The node with the title's link, and the one with its words."""
    if site.title is None:
        return row, row
    node = next((n for n in map(row.select_one, site.title) if n is not None), None)
    if node is None or site.title_inside is None:
        return node, node
    inner = node.select_one(site.title_inside)
    if inner is not None and inner.tag == "a":
        return inner, inner
    return (None, None) if node.tag != "a" else (node, inner if inner is not None else node)


def _removed(site: Site, link: Node, words: Node) -> list[Node]:
    """Nodes that the page loses before the title is read, and that later lookups don't see."""
    if not site.title_without:
        return []
    if words is link and link.tag == "a" and site.title_inside and "span" in site.title_inside:
        return []  # no inner node for the words: nothing is taken out
    found = words.select(site.title_without)
    return found[:1] if words is not link else found


def _text_without(node: Node, gone: list[Node]) -> str:
    if not gone:
        return node.text()
    out, stack = [], list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item.strip())
        elif item not in gone:
            stack.extend(reversed(item.children))
    return "".join(out)


def _inside(node: Node, gone: list[Node]) -> bool:
    at: Node | None = node
    while at is not None:
        if at in gone:
            return True
        at = at.parent
    return False


def _raw(site: Site, count: Count | None, scope: Node | None, gone: list[Node]) -> str | None:
    if count is None or count.of_title or scope is None:
        return None
    if count.cell is not None:
        kind, value = count.cell.split(":")
        cells = scope.select(site.cells)
        if kind == "width":
            found = [c for c in cells if c.attrs.get("width", "") == value]
            return found[-1].text() if found else None
        at = int(value)
        return cells[at].text() if len(cells) >= -at else None
    node = next((n for n in scope.select(count.select) if not _inside(n, gone)), None) if count.outside_title else scope.select_one(count.select)
    if node is None:
        return None
    if count.attr is not None:
        return node.attrs.get(count.attr) or node.loose_text()
    return node.loose_text() if count.outside_title else node.text()


def entries(site: Site, html: str) -> Iterator[dict]:
    """The entries of a list page in order; stops where the page can't be read on."""
    for pos, row in enumerate(_row_nodes(site, parse(html))):
        link, words = _title_nodes(site, row)
        if link is None or words is None:
            yield {"pos": pos, "has_title": False}
            continue
        scope, gone = _scope(site, row), _removed(site, link, words)
        anchor = row.select_one(site.link) if site.link else link
        image = scope.select_one(site.image) if site.image and scope is not None else None
        yield {
            "pos": pos,
            "has_title": True,
            "href": anchor.attrs.get("href", "") if anchor is not None else "",
            "text": _text_without(words, gone),
            "loose_text": words.loose_text(),
            "title_attr": link.attrs.get("title"),
            "upvotes_raw": _raw(site, site.upvotes, scope, gone),
            "comments_raw": _raw(site, site.comments, scope, gone),
            "views_raw": _raw(site, site.views, scope, gone),
            "image_raw": image.attrs.get("src") if image is not None else None,
        }


def candidates(pages: DataFrame, sites: list[Site] | None = None) -> DataFrame:
    """(source, url, html) pages to candidate entries; an `error` column says why a page has no html.

    What fails in a page ends that page alone: its earlier entries stay, and a row with `error`
    and no position says why.
    """
    rank = {s.site: i for i, s in enumerate(sites or REGISTRY)}

    def run(batches):
        for pages_ in batches:
            rows = []
            for source, url, html, failed in zip(*(c.to_pylist() for c in pages_.columns)):
                if source not in rank:
                    continue
                same = {"site_rank": rank[source], "source_site": source, "page": url}
                if failed is not None:
                    rows.append(same | {"error": failed})
                    continue
                try:
                    for entry in entries(BY_NAME[source], html):
                        rows.append(same | entry)
                except Exception as e:  # noqa: BLE001  the page's own fault; it is reported, not hidden
                    rows.append(same | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    failed = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return pages.select("source", "url", "html", failed.alias("error")).mapInArrow(run, CANDIDATES)


@F.pandas_udf(StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 resolution, for which Spark has no function."""
    return pd.Series([urljoin(b, h) if h is not None else None for b, h in zip(base, href)])


def _per_site(sites: list[Site], make, default: Column | None = None) -> Column:
    """An expression that depends on the row's site: one CASE, so that all sites share a plan."""
    out = None
    for s in sites:
        value = make(s)
        if value is not None:
            value = value if isinstance(value, Column) else F.lit(value)
            out = F.when(F.col("source_site") == s.site, value) if out is None else out.when(F.col("source_site") == s.site, value)
    default = F.lit(None) if default is None else default
    return default if out is None else out.otherwise(default)


def _url(site: Site) -> Column:
    base, href = site.base + (site.url_base or ""), F.col("href")
    return {"prefix": lambda: T.absolute(base, href), "always": lambda: F.concat(F.lit(base), href), "verbatim": lambda: href, "join": lambda: F.col("_joined"), "id": lambda: T.url_by_id(base, href)}[site.url]()


def _title(site: Site) -> Column:
    title = F.col("text")
    for step in site.clean:
        title = getattr(T, step)(title)
    if site.title_attr:
        attr = F.coalesce("title_attr", F.lit(""))
        title = T.first_of(T.strip(attr) if site.strip_attr else attr, title)
    return title


def _key(site: Site) -> Column | None:
    return {None: None, "href": F.col("href"), "url": F.col("source_url"), "page": T.without_query("source_url"), "title": F.col("title")}[site.key]


def _count(count: Count | None, raw: str) -> Column | None:
    if count is None:
        return None
    source = ("loose_text" if count.attr == "loose" else "text") if count.of_title else raw
    return getattr(T, count.parse)(source)


SLR_HOST = "media.slrclub.com"


def body_image(html: Column | str) -> Column:
    """The first image of the site's media host that is neither .gif nor .png."""
    sources = F.regexp_extract_all(html, F.lit(r"""(?idU)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']"""), F.lit(1))
    good = F.filter(sources, lambda s: F.contains(s, F.lit(SLR_HOST)) & ~F.lower(s).rlike(r"\.(gif|png)\z"))
    return T.with_scheme(F.get(good, 0), empty_is_null=False)


PAGE = ("source_site", "page")


def listed(found: DataFrame, sites: list[Site]) -> DataFrame:
    """The entries of lists that become posts, from candidates of many sites in one plan.

    `_tried` marks those whose own page is to be looked up for a picture: the first ENRICHED
    entries of a list that need one.
    """
    most = max(s.limit or s.raw_limit for s in sites)
    rows = found.filter(F.col("error").isNull() & F.col("has_title") & (F.col("pos") < _per_site(sites, lambda s: s.raw_limit, F.lit(2**31 - 1))))
    rows = rows.filter(_per_site(sites, lambda s: F.col("href").rlike(s.href_like) if s.href_like else None, F.lit(True)))
    rows = rows.filter(_per_site(sites, lambda s: F.col("href") != "" if s.key == "href" else None, F.lit(True)))
    base = _per_site(sites, lambda s: s.base + (s.url_base or "") if s.url == "join" else None, F.lit("").cast("string"))
    rows = rows.withColumn("_joined", join_url(base, F.when(base != "", F.col("href"))))
    rows = rows.withColumns({"title": _per_site(sites, _title), "source_url": _per_site(sites, _url)})
    valid = F.length("title") >= _per_site(sites, lambda s: s.least, F.lit(0))
    alone = F.concat(F.lit("#"), F.col("pos").cast("string"))  # a key of its own, for sites that don't dedup at this step
    before = _per_site(sites, lambda s: F.concat(F.lit("="), _key(s)) if s.key and s.mark == "before" else None, alone)
    after = _per_site(sites, lambda s: F.concat(F.lit("="), _key(s)) if s.key and s.mark == "after" else None, alone)
    # A page has some hundred entries at most, so all that follows is windows within pages after one exchange.
    rows = rows.withColumns({"_before": before, "_after": after}).repartition(*PAGE)
    first = lambda key: F.min("pos").over(Window.partitionBy(*PAGE, key)) == F.col("pos")
    rows = rows.withColumn("_first", first("_before")).filter(F.col("_first") & valid)
    rows = rows.withColumn("_first", first("_after")).filter("_first")
    in_order = Window.partitionBy(*PAGE).orderBy("pos")
    rows = rows.withColumn("_place", F.row_number().over(in_order)).filter(F.col("_place") <= most).filter(F.col("_place") <= _per_site(sites, lambda s: s.limit, F.lit(most)))
    image = _per_site(sites, lambda s: (T.with_scheme("image_raw") if s.image_scheme else F.col("image_raw")) if s.image else None, F.lit(None).cast("string"))
    rows = rows.withColumn("image_url", image)
    needs = _per_site(sites, lambda s: (F.coalesce("image_url", F.lit("")) == "" if s.detail_if_missing else F.lit(True)) if s.detail else None, F.lit(False))
    rows = rows.withColumn("_needs", needs)
    return rows.withColumn("_tried", F.col("_needs") & (F.sum(F.col("_needs").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) <= ENRICHED))


def detail_requests(found: DataFrame, sites: list[Site] | None = None) -> DataFrame:
    """(source, url): the pages to fetch for pictures, from candidates; each once."""
    return listed(found, sites or REGISTRY).filter("_tried").select(F.col("source_site").alias("source"), F.col("source_url").alias("url")).distinct()


def posts_of(found: DataFrame, sites: list[Site], as_of: Column, details: DataFrame | None = None) -> DataFrame:
    """Posts from candidates. details: (url, html) of the pages that detail_requests names.

    An entry whose page could not be had keeps the picture of the list, if any.
    """
    rows = listed(found, sites)
    if details is not None:
        # What isn't looked up gets a key of its own, which no page has, so that it is spread evenly.
        rows = rows.withColumn("_lookup", F.when(F.col("_tried"), F.col("source_url")).otherwise(F.concat_ws("#", F.lit(""), "page", F.col("pos").cast("string"))))
        seen = _per_site(sites, lambda s: None if not s.detail else body_image("_html") if s.detail == "body" else T.unless_contains(T.og_image("_html"), list(s.reject)))
        pictures = details.groupBy(F.col("url").alias("_lookup")).agg(F.min("html").alias("_html"))
        rows = rows.join(pictures, "_lookup", "left").withColumn("image_url", F.when(F.col("_tried"), F.coalesce(seen, "image_url")).otherwise(F.col("image_url")))
    zero = F.lit(0).cast("bigint")
    counts = {name: F.coalesce(_per_site(sites, lambda s, n=name: _count(getattr(s, n), f"{n}_raw"), zero), zero) for name in ("upvotes", "comments", "views")}
    return rows.withColumns(counts).select("site_rank", "pos", "title", "source_url", "source_site", F.lit(None).cast("string").alias("content"), "image_url", *counts, as_of.alias("created_at"))


def extract_posts(pages: DataFrame, as_of: Column, details: DataFrame | None = None, sites: list[Site] | None = None) -> DataFrame:
    """Posts of all registered sites in registry order, with seq."""
    chosen = sites or REGISTRY
    return with_seq(posts_of(candidates(pages, chosen), chosen, as_of, details))


def extraction_errors(pages: DataFrame, sites: list[Site] | None = None) -> DataFrame:
    return candidates(pages, sites).filter(F.col("error").isNotNull()).select("source_site", "page", "error")


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href, text): all links of each page in order, by the tree; a batch of pages at a time."""

    def run(batches):
        for batch in batches:
            owner, pos, href, text = [], [], [], []
            for at, html in enumerate(batch.column(1).to_pylist()):
                if html is not None:
                    for place, node in enumerate(n for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs):
                        owner.append(at)
                        pos.append(place)
                        href.append(node.attrs["href"])
                        text.append(node.text())
            keys = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array(href, pa.string()), pa.array(text, pa.string())], [key, "pos", "href", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, pos int, href string, text string")


__all__ = ["body_image", "candidates", "detail_requests", "entries", "extract_posts", "extraction_errors", "join_url", "listed", "page_links", "posts_of"]
