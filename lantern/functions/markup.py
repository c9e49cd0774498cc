"""HTML trees on the standard library's parser: reading, selecting, writing, and Markdown.

These run inside Arrow-batched functions of ``lantern.operators.html``; nothing
here knows Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends any of these that stands open, up to one of the second set.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
ENDS["tfoot"] = ENDS["thead"] = ENDS["tbody"]
#: These end an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element, or the document itself (tag '')."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def add(self, child: Node | str) -> Node | str:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in ("script", "style"):
                stack.extend(reversed(item.children))

    def text(self, separator: str) -> str:
        """The stripped, non-empty strings below, joined."""
        return separator.join(s for s in map(str.strip, self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def close_open(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        node, last = self.at, None
        while node.tag and node.tag not in stop:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self.close_open(*ENDS[tag])
        if tag in BLOCKS:
            self.close_open(frozenset({"p"}), frozenset({"td", "th", "li", "table", "button"}))
        node = self.at.add(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.tag and node.tag != tag:
            node = node.parent
        if node.tag:
            self.at = node.parent

    def handle_data(self, data):
        self.at.add(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html.removeprefix("﻿"))
    builder.close()
    return builder.root


def release(root: Node) -> None:
    """Takes a tree apart, so that its memory is free at once: parents and children refer to one another."""
    for node in list(root.walk()):
        node.parent = None


def write(node: Node | str) -> str:
    if isinstance(node, str):
        return escape(node, quote=False)
    inner = "".join(c if node.tag in ("script", "style") and isinstance(c, str) else write(c) for c in node.children)
    if not node.tag:
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}/>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def title_of(root: Node, default: str) -> str:
    """The text of the first h1, else of the title element, else the default."""
    for tag in ("h1", "title"):
        if (node := root.find(tag)) is not None and (text := node.text(" ")):
            return text
    return default


def markdown(html: str) -> str:
    """Markdown with ATX headings, ``-`` bullets and ``*`` emphasis."""
    lines = _markdown(parse(html), "").split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in lines)).strip()


def _markdown(node: Node, indent: str) -> str:
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(re.sub(r"\s+", " ", child))
            continue
        tag = child.tag
        if tag in ("script", "style", "title", "head"):
            continue
        if tag == "pre":
            out.append("\n\n```\n" + "".join(child.strings()).strip("\n") + "\n```\n\n")
            continue
        inner = _markdown(child, indent + ("  " if tag in ("ul", "ol") and indent is not None and child.parent.tag == "li" else ""))
        text = inner.strip()
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            out.append(f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else "")
        elif tag in ("strong", "b"):
            out.append(f"**{text}**" if text else "")
        elif tag in ("em", "i"):
            out.append(f"*{text}*" if text else "")
        elif tag == "code":
            out.append(f"`{text}`" if text else "")
        elif tag == "a":
            out.append(f"[{text}]({child.attrs['href']})" if child.attrs.get("href") and text else text)
        elif tag == "img":
            out.append(f"![{child.attrs.get('alt', '')}]({child.attrs.get('src', '')})")
        elif tag == "br":
            out.append("  \n")
        elif tag == "hr":
            out.append("\n\n---\n\n")
        elif tag == "li":
            siblings = [c for c in child.parent.children if isinstance(c, Node) and c.tag == "li"]
            mark = f"{siblings.index(child) + 1}." if child.parent.tag == "ol" else "-"
            out.append(f"\n{indent}{mark} {text}")
        elif tag == "table":
            rows = [[" ".join(_markdown(c, "").split()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in child.find_all("tr")]
            rows = [r for r in rows if r]
            if rows:
                body = [f"| {' | '.join(r)} |" for r in rows]
                out.append("\n\n" + "\n".join([body[0], f"| {' | '.join(['---'] * len(rows[0]))} |", *body[1:]]) + "\n\n")
        elif tag in BLOCKS:
            out.append(f"\n\n{inner.strip() if tag not in ('ul', 'ol') else inner.rstrip()}\n\n" if child.parent.tag != "li" else f"{inner.rstrip()}")
        else:
            out.append(inner)
    return "".join(out)
