"""A small HTML tree on the standard library's parser, and the selectors that site specs use.

Selectors: tag, .class, #id, [a*="v"], [a^="v"], [a="v"], :not(.class), descendants by a space,
lists by a comma. Results come in document order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("attrs", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = frozenset((attrs.get("class") or "").split())
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, without: str | None = None) -> Iterator[str]:
        """Text nodes in order, but for those in elements that match `without`."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif without is None or not matches(item, without):
                stack.extend(reversed(item.children))

    def text(self, without: str | None = None) -> str:
        """Each text node stripped, joined without a separator."""
        return "".join(s.strip() for s in self.strings(without))

    def loose_text(self) -> str:
        return "".join(self.strings())

    def ancestor(self, *tags: str) -> Node | None:
        """The nearest ancestor with the first of the tags, else with the next."""
        for tag in tags:
            node = self.parent
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None:
                return node
        return None

    def select(self, selector: str) -> list[Node]:
        return [n for n in self.walk() if matches(n, selector, self)]

    def select_one(self, selector: str) -> Node | None:
        return next((n for n in self.walk() if matches(n, selector, self)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._open(tag, attrs)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_PART = re.compile(r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)(?P<q>["'])(?P<val>.*?)(?P=q))?\]|:not\(\.(?P<no>[\w-]+)\)|(?P<tag>[\w-]+|\*)""")


@functools.cache
def _compiled(selector: str) -> tuple:
    lists = []
    for one in selector.split(","):
        steps = []
        for step in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one.strip()):
            parts, at = [], 0
            while at < len(step):
                found = _PART.match(step, at)
                if found is None:
                    raise ValueError(f"selector not understood: {selector}")
                parts.append(found.groupdict())
                at = found.end()
            steps.append(tuple(tuple(sorted((k, v) for k, v in p.items() if v is not None)) for p in parts))
        lists.append(tuple(steps))
    return tuple(lists)


def _fits(node: Node, step: tuple) -> bool:
    for part in map(dict, step):
        if "cls" in part and part["cls"] not in node.classes:
            return False
        if "id" in part and node.attrs.get("id") != part["id"]:
            return False
        if "tag" in part and part["tag"] not in ("*", node.tag):
            return False
        if "no" in part and part["no"] in node.classes:
            return False
        if "attr" in part:
            value = node.attrs.get(part["attr"])
            if value is None:
                return False
            want, op = part.get("val"), part.get("op")
            if (op == "*=" and (not want or want not in value)) or (op == "^=" and (not want or not value.startswith(want))) or (op == "=" and value != want):
                return False
    return True


def matches(node: Node, selector: str, within: Node | None = None) -> bool:
    """Whether a node matches; ancestors of a descendant selector may lie outside `within`."""
    for steps in _compiled(selector):
        if not _fits(node, steps[-1]):
            continue
        left, above = len(steps) - 2, node.parent
        while left >= 0 and above is not None:
            if _fits(above, steps[left]):
                left -= 1
            above = above.parent
        if left < 0:
            return True
    return False
