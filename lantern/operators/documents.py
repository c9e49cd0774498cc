"""From HTML pages to sections: heading hierarchy, blocks, packed parts, stable ids and flags.

Only the reading of the markup is Python; hierarchy, packing and ids are
higher-order functions on one row for each page, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import markup, text, versions

MAX_CHARS = 8000
#: Pages whose headings a task holds at once.
SLICE = 256
BLOCKS = frozenset({"p", "pre", "table", "li"})
_HEADING = "array<struct<level int, title string, anchor string, blocks array<string>>>"


def _headings(html: str) -> list[dict]:
    """Headings in document order, each with the top-level blocks that follow it; raw texts."""
    found: list[dict] = []
    for node in (root := markup.parse(html or "")).walk():
        if len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "123456":
            if title := node.text(" "):
                found.append({"level": int(node.tag[1]), "title": title, "anchor": node.attrs.get("id") or None, "blocks": []})
        elif found and node.tag in BLOCKS and not any(a.tag in BLOCKS for a in node.ancestors()):
            found[-1]["blocks"].append(node.text("\n"))
    markup.release(root)
    return found


class HtmlBlocks:
    """A table function for lateral joins: a page's blocks, one row each, as they are read.

    Each row has its heading's number (from 1), level, title, anchor (or null) and path of titles, and the block's number (from 1; 0 for
    the heading itself, whose text is its title). Titles and texts are cleaned; empty ones are left out.
    """

    def eval(self, html: str | None):
        n, stack, k = 0, [""] * 6, 0
        for node in markup.parse(html or "").walk():
            if len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "123456":
                if title := clean(node.text(" ")):
                    n, k, level = n + 1, 0, int(node.tag[1])
                    stack = [*stack[: level - 1], title, *[""] * (6 - level)]
                    at = (n, level, title, node.attrs.get("id") or None, [t for t in stack if t])
                    yield (*at, 0, title)
            elif n and node.tag in BLOCKS and not any(a.tag in BLOCKS for a in node.ancestors()):
                if body := clean(node.text("\n")):
                    k += 1
                    yield (*at, k, body)


def clean(value: str) -> str:
    """What ``text.clean_lines`` does to a column, for one string."""
    lines = (re.sub(r"[ \t\r\f\x0b]+", " ", line).strip() for line in value.splitlines())
    return "\n".join(filter(None, lines))


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` by blocks: all columns but the markup, and those of ``HtmlBlocks``."""
    blocks = F.udtf(HtmlBlocks, returnType="heading int, level int, title string, anchor string, path array<string>, block int, text string")
    named = pages.withColumnRenamed(html, "_html")
    return named.lateralJoin(blocks(F.col("_html").outer())).drop("_html")


def headings(pages: DataFrame, html: str = "html", into: str = "headings") -> DataFrame:
    """``pages`` with its headings: level, title, anchor (or null) and cleaned, non-empty blocks."""

    @F.pandas_udf(_HEADING)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            for k in range(0, len(htmls), SLICE):
                yield pd.Series([_headings(h) for h in htmls[k : k + SLICE]])

    def cleaned(h: Column) -> Column:
        blocks = F.filter(F.transform(h["blocks"], text.clean_lines), lambda b: b != "")
        return F.struct(h["level"].alias("level"), text.clean_lines(h["title"]).alias("title"), h["anchor"].alias("anchor"), blocks.alias("blocks"))

    return pages.withColumn(into, F.filter(F.transform(read(html), cleaned), lambda h: h["title"] != ""))


def hierarchy(found: Column) -> Column:
    """For each heading the titles above it and its own; skipped levels are left out."""
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def step(state: Column, heading: Column) -> Column:
        level = heading["level"]
        above = F.slice(state["stack"], F.lit(1), level - 1)
        stack = F.concat(above, F.array_repeat(F.lit(""), level - 1 - F.size(above)), F.array(heading["title"]))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.filter(stack, lambda t: t != ""))).alias("out"))

    return F.aggregate(found, empty, step, lambda s: s["out"])


def merged_breadcrumb(base: Column, internal: Column) -> Column:
    """``base`` and then ``internal`` without parts that only repeat the one before."""

    def step(done: Column, part: Column) -> Column:
        same = F.lower(text.strip(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("\x00")))) == F.lower(text.strip(part))
        return F.when(same, done).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(internal, base.cast("array<string>"), step)


def packed(blocks: Column, limit: int = MAX_CHARS) -> Column:
    """Blocks joined by blank lines as long as they fit into ``limit`` characters; longer ones are cut."""
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("open"))
    closed = lambda s: F.when(s["open"].isNull(), s["parts"]).otherwise(F.concat(s["parts"], F.array(s["open"])))

    def step(state: Column, block: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(block) - 1) / limit).cast("int")), lambda i: text.strip(F.substring(block, i * limit + 1, F.lit(limit))))
        fits = F.length(state["open"]) + 2 + F.length(block) <= limit
        joined = F.struct(state["parts"].alias("parts"), F.concat(state["open"], F.lit("\n\n"), block).alias("open"))
        fresh = F.struct(closed(state).alias("parts"), block.alias("open"))
        cut = F.struct(F.concat(closed(state), F.filter(slices, lambda x: x != "")).alias("parts"), F.lit(None).cast("string").alias("open"))
        return F.when(F.length(block) > limit, cut).when(state["open"].isNotNull() & fits, joined).otherwise(fresh)

    return F.aggregate(blocks, empty, step, closed)


def section_id(version: Column, source_path: Column, anchor: Column, part: Column, body: Column) -> Column:
    """24 hexadecimal digits that depend on the version, the place and the text alone."""
    joined = F.concat_ws("\x00", version, F.coalesce(source_path, F.lit("")), anchor, part.cast("string"), body)
    return F.substring(F.sha2(joined, 256), 1, 24)


def sections(pages: DataFrame, version: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Pages (source_path, breadcrumb, html) as sections in document order (ord)."""
    full = F.lit(versions.release(version).full)
    read = headings(pages.select("source_path", "breadcrumb", "html")).withColumn("paths", hierarchy(F.col("headings")))
    each = read.select("source_path", "breadcrumb", F.posexplode(F.arrays_zip("headings", "paths")).alias("n", "h"))
    anchor = F.coalesce("h.headings.anchor", F.concat(F.lit("section-"), (F.col("n") + 1).cast("string")))
    blocks = F.when(F.size("h.headings.blocks") > 0, F.col("h.headings.blocks")).otherwise(F.array("h.headings.title"))
    flat = each.select("source_path", "n", anchor.alias("anchor"), F.col("h.headings.title").alias("title"), merged_breadcrumb(F.col("breadcrumb"), F.col("h.paths")).alias("breadcrumb"), packed(blocks, max_chars).alias("parts"))
    parts = flat.select("source_path", "n", "anchor", "title", "breadcrumb", F.posexplode("parts").alias("k", "text")).withColumn("part", F.col("k") + 1)
    return parts.select(
        section_id(full, F.col("source_path"), F.col("anchor"), F.col("part"), F.col("text")).alias("id"),
        full.alias("source_version"),
        "anchor",
        "title",
        "breadcrumb",
        "text",
        "part",
        text.recommends(F.col("text")).alias("has_recommendation"),
        text.warns(F.col("text")).alias("has_warning"),
        "source_path",
        F.struct(F.lower("source_path").alias("path"), "n", "part").alias("ord"),
    )


def with_embedding_text(found: DataFrame, product: str = "Docs") -> DataFrame:
    return found.withColumn("embedding_text", text.embedding_text(product, F.col("source_version"), F.col("breadcrumb"), F.col("source_path"), F.col("text")))


def assert_unique(found: DataFrame, key: str = "id") -> DataFrame:
    """``found``, after an error if ``key`` isn't unique: Spark doesn't enforce primary keys."""
    twice = found.groupBy(key).count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {[r[key] for r in twice]}")
    return found
