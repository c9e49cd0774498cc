"""Crawling by an injected fetch: levels of a breadth-first search, each kept as soon as it is fetched."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import markup
from lantern.functions.urls import Site
from lantern.operators import numbering
from lantern.operators.graph import DEFAULT_TITLE
from lantern.sources.checkpoints import cut, drop, exists
from lantern.sources.corpus import PAGE, html_text, next_number

FETCHED = f"{PAGE}, html string"


@dataclass(frozen=True)
class Fetched:
    status: int
    content: bytes
    content_type: str | None = None
    final_url: str | None = None
    error: str | None = None


def now() -> str:
    return datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def fetched(urls: DataFrame, fetch: Callable[[str], Fetched], site: Site, root: str) -> DataFrame:
    """``urls`` (url, parent) fetched: the fields of a manifest's page, and html.

    Only fetching and reading the markup is Python; which links are children is told by columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, parent in zip(batch["url"], batch["parent"], strict=True):
                got, at = fetch(url), now()
                if got.status != 200:
                    rows.append((url, parent, at, got.error or f"HTTP {got.status}", None, None, None, None, None))
                    continue
                final, html = got.final_url or url, html_text(got.content)
                tree = markup.parse(html)
                addresses = [urljoin(final, a.attrs["href"]) for a in tree.find_all("a") if "href" in a.attrs]
                rows.append((url, parent, at, None, got.content_type or "text/html", final, markup.title_of(tree, DEFAULT_TITLE), html, addresses))
            yield pd.DataFrame(rows, columns=["url", "parent", "at", "failed", "type", "final", "heading", "body", "addresses"], dtype=object)

    got = urls.mapInPandas(run, "url string, parent string, at string, failed string, type string, final string, heading string, body string, addresses array<string>")
    known = got.withColumn("final", F.coalesce(site.page(F.col("final")), "url"))
    pages = F.transform("addresses", site.page)
    children = F.array_distinct(F.filter(pages, lambda c: c.isNotNull() & (c != F.col("final")) & F.startswith(c, F.lit(root))))
    ok = F.col("failed").isNull()
    values = {
        "url": F.col("url"),
        "status": F.when(ok, F.lit("ok")).otherwise(F.lit("error")),
        "discoveredAt": F.col("at"),
        "parent": F.col("parent"),
        "lastTriedAt": F.col("at"),
        "error": F.col("failed"),
        "title": F.col("heading"),
        "contentType": F.col("type"),
        "children": children,
        "fetchedAt": F.when(ok, F.col("at")),
        "html": F.col("body"),
    }
    return known.select(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in FETCHED.split(", "))))


def crawl(spark: SparkSession, start: str, fetch: Callable[[str], Fetched], site: Site, known: DataFrame | None = None, max_pages: int | None = None, keep: str | None = None) -> DataFrame:
    """All pages that links lead to from ``start``, and those known; pages that are known to be ok aren't fetched again.

    A set of visited pages ends cycles. With the folder ``keep``, each level's pages are appended
    to it as soon as they are fetched, and those that it has are known: a crawl that was stopped goes on
    where it ended, by the same call.
    """
    first, root = site.start(spark, start)
    empty = spark.createDataFrame([], FETCHED)
    earlier = empty if known is None else known
    if keep and exists(spark, keep):
        # a page may have failed before it was fetched
        kept = spark.read.schema(empty.schema).parquet(keep)
        best = kept.groupBy("url").agg(F.max_by(F.struct(*kept.columns), F.struct(F.col("status") == "ok", "lastTriedAt")).alias("p")).select("p.*")
        earlier = earlier.join(best.select("url"), "url", "left_anti").select(kept.columns).unionByName(best)
    pages = cut(earlier)
    # seq is a page's place in the queue: pages are fetched in the order in which they were found
    frontier = cut(spark.createDataFrame([(first, None, 0)], "url string, parent string, seq long"))
    visited = cut(frontier.select("url"))
    count = 0
    while not frontier.isEmpty():
        done = pages.filter("status = 'ok'").select("url", "children")
        todo = frontier.join(done, "url", "left_anti")
        if max_pages is not None:
            todo = todo.orderBy("seq").limit(max(0, max_pages - count))
        new = cut(fetched(todo.drop("seq"), fetch, site, root))
        if keep:
            new.write.mode("append").parquet(keep)
        count += new.count()
        older, pages = pages, cut(pages.join(new, "url", "left_anti").select(new.columns).unionByName(new))
        here = frontier.select("url", "seq").join(pages.filter("status = 'ok'").select("url", "children"), "url").select(F.col("url").alias("parent"), "seq", F.posexplode("children").alias("ord", "url"))
        seen = here.groupBy("url").agg(F.min(F.struct("seq", "ord", "parent")).alias("m")).select("url", "m.*")
        found = numbering.numbered(seen.join(visited, "url", "left_anti"), ["seq", "ord"]).select("url", "parent", F.col("number").alias("seq"))
        spent = [older, new, frontier, visited]
        frontier = cut(found)
        visited = cut(visited.unionByName(frontier.select("url")))
        drop(*spent)
        if max_pages is not None and count >= max_pages:
            break
    return pages


def numbered(pages: DataFrame) -> DataFrame:
    """Pages with the names of their files, four digits each: those without one go on from the highest number, in order of address."""
    first = pages.agg(next_number(pages)).first()[0]
    new = numbering.numbered(pages.filter("status = 'ok' AND file IS NULL").select("url"), ["url"])
    named = new.select("url", F.concat(F.lit("pages/"), F.format_string("%04d", F.col("number") + first), F.lit(".html")).alias("new_file"))
    return pages.join(named, "url", "left").withColumn("file", F.coalesce("file", "new_file")).drop("new_file")


def manifest(pages: DataFrame, start: str, root: str) -> str:
    """A crawl's manifest as JSON."""
    fields = [c.split()[0] for c in PAGE.split(", ")]
    entries = {r["url"]: {k: v for k, v in r.asDict().items() if v is not None} for r in pages.select(*fields).orderBy("url").collect()}
    return json.dumps({"schemaVersion": 1, "createdAt": now(), "updatedAt": now(), "startUrl": start, "allowedRoot": root, "pages": entries}, ensure_ascii=False, indent=2) + "\n"


def cookies(spark: SparkSession, text: str | None) -> dict[str, str]:
    """Cookies from JSON: an object, or a list of objects with name and value."""
    form = "map<string,string>" if (text or "{}").lstrip().startswith("{") else "array<struct<name:string,value:string>>"
    named = F.from_json("text", form)
    if form.startswith("array"):
        named = F.map_from_entries(F.transform(F.filter(named, lambda c: F.coalesce(c["name"], F.lit("")) != ""), lambda c: F.struct(c["name"], F.coalesce(c["value"], F.lit("")))))
    found = spark.createDataFrame([(text or "{}",)], "text string").select(named.alias("named")).first()["named"]
    if found is None:
        raise ValueError("cookies must be an object or a list of names and values")
    return found


def header(option: str) -> tuple[str, str]:
    """A NAME=VALUE option; the type of such an argument."""
    if (parts := re.fullmatch(r"\s*([^=]*[^=\s])\s*=(.*)", option, re.S)) is None:
        raise ValueError(f"NAME=VALUE is asked for, not {option!r}")
    return parts[1], parts[2]


def http_fetch(headers: dict[str, str] | None = None, cookie: dict[str, str] | None = None, timeout: float = 30.0, delay: float = 0.0) -> Callable[[str], Fetched]:
    """A fetch over HTTP that follows redirects, ``delay`` seconds after the one before in the same worker. What fails is a page with an error, not the end of a crawl."""

    def fetch(url: str) -> Fetched:
        import time
        from http.client import HTTPException
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        sent = {"User-Agent": "lantern"} | (headers or {}) | ({"Cookie": "; ".join(f"{k}={v}" for k, v in cookie.items())} if cookie else {})
        time.sleep(delay)
        try:
            with urlopen(Request(url, headers=sent), timeout=timeout) as answer:
                return Fetched(answer.status, answer.read(), answer.headers.get("Content-Type"), answer.url)
        except HTTPError as error:
            return Fetched(error.code, b"")
        except (OSError, HTTPException) as error:
            return Fetched(0, b"", error=f"{type(error).__name__}: {error}")

    return fetch
