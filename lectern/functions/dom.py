"""A small tree of HTML elements and the selectors that pages are read by: tag, #id, .class, [name="x"], [name*="x"], and descendants."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Elements that have no end tag.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
_PART = re.compile(r"""(?P<tag>^[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?P<how>[*]?=)["'](?P<value>[^"']*)["']\]""")


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        left = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while left:
            node = left.pop()
            yield node
            left += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def strings(self) -> Iterator[str]:
        left: list[Node | str] = list(reversed(self.kids))
        while left:
            x = left.pop()
            if isinstance(x, str):
                yield x
            else:
                left += reversed(x.kids)

    def text(self, gap: str = "", strip: bool = True) -> str:
        """All text below; with ``strip`` each string bare and blank ones left out."""
        return gap.join(s for x in self.strings() if (s := x.strip() if strip else x))

    def drop(self, selectors: list[str]) -> None:
        """Removes the elements below that a selector fits."""
        for node in [n for n in self.walk() if any(fits(n, s) for s in selectors)]:
            if node.parent is not None and node in node.parent.kids:
                node.parent.kids.remove(node)

    def first(self, selector: str) -> Node | None:
        return next((n for n in self.walk() if fits(n, selector)), None)

    def all(self, selector: str) -> list[Node]:
        return [n for n in self.walk() if fits(n, selector)]


@lru_cache(maxsize=1024)
def _steps(selector: str) -> tuple[tuple[tuple[str, str, str], ...], ...]:
    return tuple(
        tuple((m.lastgroup, m["name"] or "", m["how"] or "", m["value"] or "") if m["name"] else (m.lastgroup, "", "", m[m.lastgroup]) for m in _PART.finditer(step))
        for step in selector.split()
    )


def _fits_one(node: Node, parts: tuple) -> bool:
    for kind, name, how, value in parts:
        if kind == "tag":
            ok = node.tag == value
        elif kind == "id":
            ok = node.attrs.get("id") == value
        elif kind == "cls":
            ok = value in node.attrs.get("class", "").split()
        else:
            own = node.attrs.get(name)
            ok = own is not None and (value in own if how == "*=" else own == value)
        if not ok:
            return False
    return True


def fits(node: Node, selector: str) -> bool:
    """Whether the last step fits ``node`` and those before it fit elements around it, from the inside out."""
    steps = _steps(selector)
    if not _fits_one(node, steps[-1]):
        return False
    around = node.parent
    for step in reversed(steps[:-1]):
        while around is not None and not _fits_one(around, step):
            around = around.parent
        if around is None:
            return False
        around = around.parent
    return True


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end tag without a start is ignored
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parsed(html: str | None) -> Node:
    """The tree of ``html``; null is an empty page, and tags left open end with the page."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
