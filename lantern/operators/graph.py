"""Link graphs of pages: edges, roots, breadth-first levels, and paths of the exported tree."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import markup, text
from lantern.functions.urls import Site
from lantern.operators.numbering import numbered
from lantern.sources.checkpoints import cut, drop

PATH_CHARS, LEAST_CHARS = 180, 24
EXTRAS = "Дополнительные материалы"
DEFAULT_TITLE = "Страница"
# Chapters that are roots, in this order, where they exist.
CHAPTERS = (
    "Глава 1. Состав библиотеки",
    "Глава 2. Инструкция по внедрению библиотеки",
    "Глава 3. Настройка и использование подсистем при разработке конфигурации",
    "Глава 4. Программный интерфейс",
    "Глава 5. Пользовательская документация",
    "Приложение 1. Формат файла сообщения обмена данными",
    "Приложение 2. Доступные параметры запуска приложения",
    "Приложение 3. Международная поставка без национальной специфики",
)


def read_links(pages: DataFrame, site: Site | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages (url, html) as url, the columns ``keep``, and links, in order: href, page (the canonical one with ``site``, the href without) and whether it is in an index block."""

    def found(html: str, url: str) -> list[tuple]:
        anchors = (a for a in markup.parse(html or "").find_all("a") if "href" in a.attrs)
        return [(a.attrs["href"], urljoin(url, a.attrs["href"]) if site else a.attrs["href"], any("index" in n.classes() for n in a.ancestors())) for a in anchors]

    @F.pandas_udf("array<struct<href string, address string, indexed boolean>>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, addresses in batches:
            yield pd.Series([found(h, u) for h, u in zip(htmls, addresses, strict=True)])

    page = site.page if site else lambda address: address
    return pages.select("url", *keep, F.transform(read("html", "url"), lambda x: F.struct(x["href"].alias("href"), page(x["address"]).alias("page"), x["indexed"].alias("indexed"))).alias("links"))


def links(pages: DataFrame, site: Site | None = None, root: str | None = None, index_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per link of pages (url, html): src, the page's columns ``keep``, ord, dst; each target once, in order, none to the page itself.

    Several pages may have one address; ``keep`` tells them apart. With ``site``, targets are canonical pages of it, below ``root`` if given;
    without, they are the hrefs. ``index_only`` takes the links of index blocks.
    """

    def wanted(x: Column) -> Column:
        own = x["page"].isNotNull() & (x["page"] != "") & (x["page"] != F.col("url"))
        return own & (F.startswith(x["page"], F.lit(root)) if root else F.lit(True)) & (x["indexed"] if index_only else F.lit(True))

    targets = F.array_distinct(F.transform(F.filter("links", wanted), lambda x: x["page"]))
    return read_links(pages, site, keep).select(F.col("url").alias("src"), *keep, F.posexplode(targets).alias("ord", "dst"))


def known_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose target is one of ``pages``."""
    return edges.join(pages.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst", "ord")


def roots(pages: DataFrame, edges: DataFrame, chapters: tuple[str, ...] = CHAPTERS) -> DataFrame:
    """url and ord of the roots: the known chapters; where there is none, pages without incoming links by title."""
    named = pages.join(F.broadcast(pages.sparkSession.createDataFrame([(t, i) for i, t in enumerate(chapters)], "title string, n int")), "title")
    first = named.groupBy("n").agg(F.max("url").alias("url")).select("url", F.struct(F.lpad(F.col("n").cast("string"), 4, "0").alias("a"), F.lit("").alias("b")).alias("ord"))
    if not first.isEmpty():
        return first
    free = pages.join(edges.select(F.col("dst").alias("url")), "url", "left_anti")
    return free.select("url", F.struct(F.lower("title").alias("a"), F.col("url").alias("b")).alias("ord"))


def levels(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """Breadth-first search: url, level and parent (first seen: by the parent's order, then the link's).

    Pages that were visited are never visited again, so cycles end. Each level
    is a join with the links and is cut by a checkpoint.
    """
    visited = cut(starts.select("url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")).distinct())
    frontier, level = visited, 0
    while most is None or level < most:
        level += 1
        found = frontier.select(F.col("url").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", "ord")).alias("first"))
        spent = [] if frontier is visited else [frontier]
        frontier = cut(found.join(visited, "url", "left_anti").select("url", F.lit(level).alias("level"), F.col("first.src").alias("parent")))
        drop(*spent)
        if frontier.isEmpty():
            break
        before, visited = visited, cut(visited.unionByName(frontier))
        drop(before)
    return visited


def first_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Of the pages that links (src, dst, ord) lead to from ``starts`` (url, key): url, parent and key, by the path that comes first.

    A path's key is its start's and the numbers of its links, so paths are in the order of a walk
    that follows each link before the next. Every round goes one link further from the pages
    whose key has improved, until none does; a path never meets a page twice.
    """
    best = frontier = cut(starts.select("url", "key", F.lit(None).cast("string").alias("parent"), F.array("url").alias("chain")))
    while not frontier.isEmpty():
        ahead = frontier.join(edges, F.col("url") == F.col("src")).filter(~F.array_contains("chain", F.col("dst")))
        path = F.struct(F.concat("key", F.array(F.col("ord").cast("long"))).alias("key"), F.col("url").alias("parent"), F.concat("chain", F.array("dst")).alias("chain"))
        led = ahead.groupBy(F.col("dst").alias("url")).agg(F.min(path).alias("p")).select("url", "p.key", "p.parent", "p.chain")
        old = best.select(F.col("url").alias("o_url"), F.col("key").alias("o_key"))
        spent = [frontier, best]
        frontier = cut(led.join(old, F.col("url") == F.col("o_url"), "left").filter("o_key IS NULL OR key < o_key").drop("o_url", "o_key"))
        best = cut(best.join(frontier.select("url"), "url", "left_anti").unionByName(frontier))
        drop(*spent)
    return best.select("url", "parent", "key")


def file_names(found: DataFrame, taken: DataFrame) -> DataFrame:
    """``found`` (folder, title, url, extension, key) with ``name``: of bounded length, unlike others in its folder whatever their case.

    Of equal names the first by key keeps its own, unless it is ``taken`` (folder, folded); the rest have a digest of their address.
    """
    room = F.greatest(F.lit(LEAST_CHARS), PATH_CHARS - F.when(F.col("folder") == "", 0).otherwise(F.length("folder") + 1) - F.when(F.col("extension") == "", len("/index.html")).otherwise(F.length("extension")))
    digest = F.concat(F.lit("-"), F.substring(F.sha2("url", 256), 1, 8))
    marked = lambda name: F.concat(F.regexp_replace(F.substring(name, F.lit(1), F.greatest(F.lit(1), F.col("room") - 9)), r"[ .]+$", ""), digest)
    whole = found.withColumn("room", room).withColumn("slug", text.slug(F.col("title")))
    short = whole.withColumn("slug", F.when(F.length("slug") > F.col("room"), marked(F.col("slug"))).otherwise(F.col("slug")))
    folded = short.withColumn("folded", F.lower(F.concat("slug", "extension")))
    turn = F.row_number().over(Window.partitionBy("folder", "folded").orderBy("key", "url"))
    known = taken.select(F.col("folder").alias("t_folder"), F.col("folded").alias("t_folded"), F.lit(True).alias("is_taken")).distinct()
    both = folded.withColumn("turn", turn).join(known, (F.col("folder") == F.col("t_folder")) & (F.col("folded") == F.col("t_folded")), "left")
    own = (F.col("turn") == 1) & F.col("is_taken").isNull()
    return both.withColumn("name", F.concat(F.when(own, F.col("slug")).otherwise(marked(F.col("slug"))), "extension")).drop("room", "slug", "folded", "turn", "t_folder", "t_folded", "is_taken")


def tree_paths(pages: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Paths of an export: url, path. Pages with links of their own are folders, others are files; a page belongs to the first path to it.

    ``pages`` has url, title and parent, ``edges`` src, dst and ord, ``starts`` url and ord. Pages that no
    start leads to go to the folder of their recorded parent after all others, or else to a folder of extras.
    One level of the tree is named at a time.
    """
    roots = numbered(starts, ["ord"], into="n").select("url", F.array(F.lit(0).cast("long"), "n").alias("key"))
    reached = first_paths(edges, roots)
    others = pages.join(reached, "url", "left_anti").withColumn("folded", F.lower(F.coalesce("title", F.lit(""))))
    rest = cut(numbered(others, ["folded", "url"], into="n").select("url", F.col("parent").alias("above"), "n"))
    inner = edges.join(rest.select(F.col("url").alias("src")), "src", "left_semi").join(rest.select(F.col("url").alias("dst")), "dst", "left_semi")
    recorded = rest.filter("above IS NOT NULL").select(F.col("above").alias("src"), F.col("url").alias("dst"), (F.col("n") + (1 << 40)).alias("ord"))
    extras = rest.select("url", F.array(F.lit(1).cast("long"), "n").alias("key"))
    # a page whose recorded parent has a place begins at that place; the rest are extras
    placed = reached.select(F.col("url").alias("src"), F.col("key").alias("above_key"))
    late = recorded.join(placed, "src").select(F.col("dst").alias("url"), F.concat("above_key", F.array("ord")).alias("key"))
    begun = late.unionByName(extras.join(late, "url", "left_anti"))
    led = first_paths(inner.select("src", "dst", F.col("ord").cast("long").alias("ord")).unionByName(recorded.join(placed, "src", "left_anti")), begun)
    parent = led.join(recorded.select(F.col("src").alias("r_parent"), F.col("dst").alias("url")).join(placed.select(F.col("src").alias("r_parent")), "r_parent", "left_semi"), "url", "left")
    tree = reached.unionByName(parent.select("url", F.coalesce("parent", "r_parent").alias("parent"), "key"))
    heads = edges.select(F.col("src").alias("url"), F.lit(True).alias("leads")).distinct()
    root_urls = starts.select("url", F.lit(True).alias("is_root"))
    titled = pages.select("url", F.coalesce(F.nullif("title", F.lit("")), F.lit(DEFAULT_TITLE)).alias("title"))
    extension = F.when(F.coalesce("leads", F.lit(False)) | F.coalesce("is_root", F.lit(False)), F.lit("")).otherwise(F.lit(".html"))
    left = cut(tree.join(titled, "url").join(heads, "url", "left").join(root_urls, "url", "left").select("url", "parent", "key", "title", extension.alias("extension"), F.coalesce("is_root", F.lit(False)).alias("is_root")))
    first = F.when(F.col("is_root"), F.lit("")).otherwise(F.lit(EXTRAS))
    level = left.filter("parent IS NULL").withColumn("folder", first)
    done = None
    while True:
        taken = pages.sparkSession.createDataFrame([], "folder string, folded string") if done is None else done.select("folder", F.lower("name").alias("folded"))
        inside = F.concat(F.when(F.col("folder") == "", F.lit("")).otherwise(F.concat("folder", F.lit("/"))), "name")
        named = file_names(level, taken).withColumn("path", F.when(F.col("extension") == "", F.concat(inside, F.lit("/index.html"))).otherwise(inside))
        named = cut(named.select("url", "folder", "name", "path"))
        if named.isEmpty():
            return done.select("url", "path") if done is not None else named.select("url", "path")
        before, done = done, cut(named if done is None else done.unionByName(named))
        if before is not None:
            drop(before)
        above = named.select(F.col("url").alias("parent"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
        level = left.join(above, "parent")
