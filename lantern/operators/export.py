"""Exporting readable pages: cleaning, chapter splitting, link rewriting, rendering, manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import count, takewhile
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import urls
from lantern.functions.markup import Node, parse, write
from lantern.operators import graph
from lantern.operators.graph import DEFAULT_TITLE, read_links
from lantern.sources import corpus
from lantern.sources.checkpoints import cut
from lantern.sources.sink import write_pages

CONTENTS = "Оглавление"
STYLE = "body{margin:0;font:16px/1.5 sans-serif}main{max-width:64rem;margin:auto;padding:2rem}img{max-width:100%}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3rem .5rem}.row-number{text-align:right}"
#: Characters that names of files can't have.
UNFIT = r'[<>:"/\\|?*]'
EMPTY_GOES = frozenset({"div", "nav", "header", "footer", "aside"})
LINKS = ("href", "src")


def _awaits_number(cell: Node | str) -> bool:
    """Whether a table's cell begins with the empty item of a numbered list."""
    if isinstance(cell, str) or cell.tag != "td":
        return False
    items = (n for n in cell.walk() if n.tag == "li" and n.parent.tag == "ol" and "n" in n.parent.classes())
    first = next(items, None)
    return first is not None and not first.text("")


def kept(node: Node, link: Callable[[str], str], rows: Iterator[int] | None = None, filters: bool = False) -> Node | None:
    """A copy of ``node`` as it is exported: without scripts, filters' forms and empty containers, rows numbered, links rewritten.

    ``rows`` numbers the rows of the table around; ``filters`` tells that a filter's place is around.
    """
    filters = filters or "filter_place" in node.classes()
    if node.tag == "script" or filters and node.tag == "form":
        return None
    out = Node(node.tag, {k: link(v) if k in LINKS else v for k, v in node.attrs.items()})
    if node.tag == "table" and rows is None:
        rows = count(1)
    cell = next((c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")), None) if node.tag == "tr" and rows else None
    for child in node.children:
        if child is cell and cell is not None and _awaits_number(cell):
            numbered = out.add(Node("td", cell.attrs | {"class": " ".join([*cell.classes(), "row-number"])}))
            numbered.add(str(next(rows)))
        elif isinstance(child, str):
            out.add(child)
        elif (copy := kept(child, link, rows, filters)) is not None:
            out.add(copy)
    return None if out.tag in EMPTY_GOES and not out.text("") else out


def page(title: str, content: str, nav: str = "", lang: str = "ru") -> str:
    head = f'<meta charset="utf-8"/><meta name="viewport" content="width=device-width, initial-scale=1"/><title>{write(title)}</title><style>{STYLE}</style>'
    return f'<!DOCTYPE html><html lang="{lang}"><head>{head}</head><body><main>{nav}{content}</main></body></html>'


def chapters(html: str) -> list[tuple[str, str, str]]:
    """(title, path, html) of each h1 and the siblings that follow it, up to the next h1; blank ones are left out."""
    titled = {h: " ".join(h.text(" ").split()) for h in parse(html).find_all("h1")}
    paths = {h: f"{slug(t)}/index.html" for h, t in titled.items() if t}
    places = {h.attrs["id"]: path for h, path in paths.items() if h.attrs.get("id")}
    out = []
    for h, path in paths.items():
        siblings = h.parent.children
        body = [h, *takewhile(lambda x: isinstance(x, str) or x.tag != "h1", siblings[siblings.index(h) + 1 :])]
        copies = (x if isinstance(x, str) else kept(x, lambda link: urls.within(link, places)) for x in body if not isinstance(x, str) or x.strip())
        out.append((titled[h], path, page(titled[h], "".join(write(c) for c in copies if c is not None))))
    return out


def slug(title: str) -> str:
    """A title as the name of a folder."""
    return " ".join(re.sub(UNFIT, " ", title).split()).strip(" .") or "index"


def crawled(html: str, url: str, title: str, path: str, targets: dict[str, str]) -> str:
    """A crawled page for export; ``targets`` has the new place of each link that leads to another exported page."""
    root = parse(html)
    body = Node("")

    def link(href: str) -> str:
        if href in targets:
            return urls.between(path, targets[href].partition("#")[0]) + "".join(targets[href].partition("#")[1:])
        return urljoin(url, href) if href and not href.startswith(("#", "mailto:", "javascript:")) else href

    for child in (root.find("body") or root).children:
        if (copy := child if isinstance(child, str) else kept(child, link)) is not None:
            body.add(copy)
    nav = f'<nav><a href="{urls.between(path, "index.html")}">{CONTENTS}</a></nav>'
    return page(title, write(body), nav)


def chapter_pages(sources: DataFrame) -> DataFrame:
    """Chapters of documents (html): title, path, page."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([c for h in batch["html"] for c in chapters(h)], columns=["title", "path", "page"], dtype=object)

    return sources.select("html").mapInPandas(split, "title string, path string, page string")


def rendered(pages: DataFrame, paths: DataFrame, site: urls.Site) -> DataFrame:
    """Crawled pages (url, title, html) as they are exported to ``paths`` (url, path): url, title, path, page.

    Links find the places of other pages by a join; a page's own ones come back as one map.
    """
    each = read_links(pages, site).select("url", F.explode("links").alias("l")).select("url", "l.href", F.col("l.page").alias("target"))
    places = paths.select(F.col("url").alias("target"), F.col("path").alias("place"))
    anchor = F.regexp_extract("href", r"(#.+)$", 1)
    led = each.join(places, "target").groupBy("url").agg(F.map_from_entries(F.collect_set(F.struct("href", F.concat("place", anchor)))).alias("targets"))

    @F.pandas_udf("string")
    def render(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([crawled(html, url, title, path, dict(targets or {})) for html, url, title, path, targets in zip(*columns, strict=True)], dtype=object)

    named = pages.select("url", F.coalesce(F.nullif("title", F.lit("")), F.lit(DEFAULT_TITLE)).alias("title"), "html")
    whole = named.join(paths.select("url", "path"), "url").join(led, "url", "left")
    return whole.select("url", "title", "path", render("html", "url", "title", "path", "targets").alias("page"))


def export_manifest(pages: DataFrame) -> str:
    """The exported pages as JSON, by title."""
    items = [{"sourceUrl": r["url"], "title": r["title"], "path": r["path"]} for r in pages.select("url", "title", "path").collect()]
    items.sort(key=lambda x: (x["title"].casefold(), x["sourceUrl"]))
    return json.dumps({"schemaVersion": 1, "pages": len(items), "items": items}, ensure_ascii=False, indent=2) + "\n"


def index_page(title: str, roots: list[tuple[str, str]]) -> str:
    """The page that lists the roots (title, path)."""
    rows = "".join(f"<li>{write(_link(name, path))}</li>" for name, path in roots)
    return page(title, f"<h1>{write(title)}</h1><ul>{rows}</ul>")


def _link(name: str, path: str) -> Node:
    a = Node("a", {"href": path})
    a.add(name)
    return a


def export_crawl(spark: SparkSession, manifest_path: str, folder: str, site: urls.Site) -> DataFrame:
    """Exports the finished pages of a crawl's manifest to ``folder``: pages, index and manifest. Returns url, title, path, page."""
    pages = cut(corpus.crawled_pages(spark, manifest_path))
    edges = cut(graph.known_links(graph.links(pages, site, index_only=True), pages))
    roots = cut(graph.roots(pages, edges))
    paths = graph.tree_paths(pages, edges, roots)
    out = cut(rendered(pages, paths, site))
    write_pages(out, folder)
    starts = roots.join(out.select("url", "title", "path"), "url").orderBy("ord").select("title", "path").collect()  # one row for each chapter
    extra = [("index.html", index_page(CONTENTS, [tuple(r) for r in starts])), ("manifest.json", export_manifest(out))]
    write_pages(spark.createDataFrame(extra, "path string, page string"), folder)
    return out
