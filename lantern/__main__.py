"""Commands: index, inspect, export-html, export-crawl, crawl, build-navigation, search, serve.

``python -m lantern COMMAND --help`` lists a command's options.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lantern.functions.urls import Site
from lantern.operators import documents, export, hybrid, navigation
from lantern.plans import server
from lantern.plans.api import Tools
from lantern.sources import corpus, crawl
from lantern.sources.store import Store


def navigation_json(spark: SparkSession, source: str, version: str) -> str:
    """The catalogue of a documentation tree as JSON."""
    found = navigation.nested(navigation.build(corpus.html_files(spark, source))).orderBy(F.lower("name"))
    sections = [json.loads(r[0]) for r in found.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    return json.dumps({"schema_version": 2, "source_version": version, "root": navigation.ROOT, "sections": sections}, ensure_ascii=False, indent=2) + "\n"


def save(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lantern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    site = ("--base", "--prefix")
    for name, options in {
        "index": ("--root", "--source", "--version"),
        "inspect": ("--root", "--version"),
        "export-html": ("--source", "--output"),
        "export-crawl": ("--source", "--output", *site),
        "build-navigation": ("--source", "--version", "--output"),
        "search": ("--root", "--version", "--query"),
        "serve": ("--root",),
        "crawl": ("--start", "--output", *site),
    }.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(option, required=True)
        if name == "crawl":
            command.add_argument("--max-pages", type=int)
            command.add_argument("--cookies")
            command.add_argument("--header", type=crawl.header, action="append", default=[])
            command.add_argument("--cookie", type=crawl.header, action="append", default=[])
            command.add_argument("--delay", type=float, default=0.0)
    found = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    {"index": index, "inspect": inspect, "export-html": export_html, "export-crawl": export_crawl, "build-navigation": build_navigation, "search": search, "serve": serve, "crawl": crawl_site}[found.command](spark, found)
    return 0


def index(spark: SparkSession, found: argparse.Namespace) -> None:
    tree = os.path.isdir(found.source)
    pages = corpus.scan(spark, found.source) if tree else corpus.scan_file(spark, found.source)
    name = Store(spark, f"{found.root}/indexes").build(documents.sections(pages, found.version), embedder(), found.version, found.source)
    if tree:
        save(f"{found.root}/navigation/{found.version}.json", navigation_json(spark, found.source, found.version))
    print(name)


def inspect(spark: SparkSession, found: argparse.Namespace) -> None:
    store = Store(spark, f"{found.root}/indexes")
    print(json.dumps(store.metadata(".".join(found.version.split(".")[:2])), ensure_ascii=False, indent=2))


def export_html(spark: SparkSession, found: argparse.Namespace) -> None:
    export.write_pages(export.chapter_pages(corpus.scan_file(spark, found.source)), found.output)


def export_crawl(spark: SparkSession, found: argparse.Namespace) -> None:
    export.export_crawl(spark, found.source, found.output, Site(found.base, (found.prefix,), found.prefix))


def build_navigation(spark: SparkSession, found: argparse.Namespace) -> None:
    save(found.output, navigation_json(spark, found.source, found.version))


def search(spark: SparkSession, found: argparse.Namespace) -> None:
    for row in Tools(spark, found.root, embedder()).search(found.version, found.query).collect():
        print(json.dumps(row.asDict(), ensure_ascii=False))


def serve(spark: SparkSession, found: argparse.Namespace) -> None:
    server.serve(Tools(spark, found.root, embedder()), sys.stdin, sys.stdout)


def crawl_site(spark: SparkSession, found: argparse.Namespace) -> None:
    site = Site(found.base, (found.prefix,), found.prefix)
    cookie = crawl.cookies(spark, open(found.cookies, encoding="utf-8").read() if found.cookies else None) | dict(found.cookie)
    fetch = crawl.http_fetch(headers=dict(found.header), cookie=cookie, delay=found.delay)
    pages = crawl.numbered(crawl.crawl(spark, found.start, fetch, site, max_pages=found.max_pages, keep=f"{found.output}/fetched"))
    export.write_pages(pages.filter("status = 'ok'").select(F.col("file").alias("path"), F.col("html").alias("page")), found.output)
    save(f"{found.output}/manifest.json", crawl.manifest(pages, found.start, site.start(spark, found.start)[1]))


def embedder() -> hybrid.Embedder:
    """The provider that the environment names, or else the hashing embedder."""
    return hybrid.Provider.from_environment() if os.environ.get(hybrid.PROVIDER_URL) else hybrid.HashingEmbedder()


if __name__ == "__main__":
    raise SystemExit(main())
