"""Scans: HTML trees, single files, crawl and release manifests, navigation files, project files, archives, bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import markup, versions
from lantern.sources.archive import members

PAGE = "url string, discoveredAt string, status string, title string, file string, contentType string, children array<string>, parent string, fetchedAt string, lastTriedAt string, error string"
CRAWL_MANIFEST = f"schemaVersion int, createdAt string, updatedAt string, startUrl string, allowedRoot string, pages map<string, struct<{', '.join(p.replace(' ', ': ', 1) for p in PAGE.split(', '))}>>"
METHOD = "struct<method: string, purpose: string, source_path: string>"
GROUP = f"struct<id: string, name: string, description: string, keywords: array<string>, interface_kind: string, source_prefix: string, method_count: int, methods: array<{METHOD}>, evidence_methods: array<string>, confidence: string, source_hash: string>"
SECTION = f"struct<name: string, description: string, keywords: array<string>, source_path: string, kinds: array<string>, method_count: int, groups: array<{GROUP}>>"
#: Members of archives are given on once they have so many bytes.
MEMBER_BYTES = 8 << 20
NAVIGATION = f"schema_version int, source_version string, root string, sections array<{SECTION}>"
RELEASES = "schema_version int, releases array<struct<documentation_version: string, index_family: string, navigation_version: string, demo_version: string, demo_archive: string, demo_sha256: string, demo_content_root: string, demo_format: string>>"


def relative_path(root: str) -> Column:
    """A file's path below ``root``, decoded."""
    whole = F.col("_metadata.file_path")
    plain = F.url_decode(F.replace(whole, F.lit("+"), F.lit("%2B")))
    bare = "/" + re.sub(r"^[a-z]+:/*", "", root).strip("/") + "/"
    return F.try_element_at(F.split(plain, re.escape(bare), 2), F.lit(2))


def html_files(spark: SparkSession, root: str) -> DataFrame:
    """Every ``.html`` file below ``root``: source_path, html."""
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[hH][tT][mM][lL]").load(root)
    return read.select(relative_path(root).alias("source_path"), F.regexp_replace("value", "^﻿", "").alias("html"))


def without_aggregates(pages: DataFrame) -> DataFrame:
    """Pages without the index pages of folders that hold others, with breadcrumb and ord.

    A folder below counts as holding others even if it has only its own index.
    """
    placed = pages.withColumn("parts", F.split("source_path", "/")).withColumn("folder", F.slice("parts", F.lit(1), F.size("parts") - 1)).withColumn("is_index", F.lower(F.element_at("parts", -1)) == "index.html")
    prefixes = F.transform(F.sequence(F.lit(0), F.size("folder")), lambda i: F.array_join(F.slice("folder", F.lit(1), i), "/"))
    holders = F.when(F.col("is_index"), F.slice(prefixes, F.lit(1), F.size("folder"))).otherwise(prefixes)
    busy = placed.select(F.explode(holders).alias("busy")).distinct()
    here = F.array_join("folder", "/")
    kept = placed.withColumn("here", F.when(F.col("is_index"), here)).join(busy, F.col("here") == F.col("busy"), "left_anti")
    return kept.select("source_path", F.col("folder").alias("breadcrumb"), *(c for c in pages.columns if c != "source_path"), F.lower("source_path").alias("ord"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The pages of a documentation tree: source_path, breadcrumb, html, ord; errors if there are none."""
    try:
        pages = html_files(spark, root)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(root) from error
        raise
    found = without_aggregates(pages)
    if pages.isEmpty():
        raise ValueError(f"no HTML files below {root}")
    return found


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One page by its file: its name is its path, and nothing is above it."""
    read = spark.read.option("wholetext", True).text(path)
    return read.select(F.lit(path.rsplit("/", 1)[-1]).alias("source_path"), F.array().cast("array<string>").alias("breadcrumb"), F.col("value").alias("html"), F.lit("").alias("ord"))


def crawl_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per page of a crawl manifest: page_url and its fields."""
    read = spark.read.schema(T._parse_datatype_string(CRAWL_MANIFEST)).option("multiLine", True).json(path)
    return read.select(F.explode("pages").alias("page_url", "p")).select("page_url", "p.*")


def finished(pages: DataFrame) -> DataFrame:
    """Pages that were fetched and have a file."""
    return pages.filter((F.col("status") == "ok") & (F.coalesce("file", F.lit("")) != ""))


def crawled_pages(spark: SparkSession, manifest: str) -> DataFrame:
    """Finished pages of a manifest with their html: url, title, parent, html."""
    folder = manifest.rsplit("/", 1)[0]
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    htmls = files.select(relative_path(folder).alias("file"), F.regexp_replace("value", "^﻿", "").alias("html"))
    return finished(crawl_manifest(spark, manifest)).select(F.col("page_url").alias("url"), "title", "parent", "file").join(htmls, "file").select("url", "title", "parent", "html")


def counters(pages: DataFrame, since: str | None = None) -> DataFrame:
    """One row: pages and errors of a crawl, and of its pages those fetched (from the moment ``since``) and those skipped, as they were there."""
    ok = F.col("status") == "ok"
    new = ok & (F.lit(True) if since is None else F.coalesce(F.col("fetchedAt") >= since, F.lit(False)))
    return pages.agg(F.count_if(ok).alias("pages"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(new).alias("fetched"), F.count_if(ok & ~new).alias("skipped"))


def file_digest(spark: SparkSession, path: str) -> str:
    """sha256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def next_number(pages: DataFrame) -> Column:
    """The number of the next page file, as an aggregate over ``file``."""
    return F.coalesce(F.max(F.regexp_extract("file", r"(?:^|/)(\d+)\.[^./]*$", 1).try_cast("int")), F.lit(0)) + 1


def navigation_file(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A navigation file as one row; an error if it is of another version."""
    try:
        read = spark.read.schema(T._parse_datatype_string(NAVIGATION)).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    found = [r[0] for r in read.select("source_version").collect()]
    if found != [version]:
        raise ValueError(f"expected navigation of {version}, found {found}")
    return read


def releases(spark: SparkSession, path: str, key: str = "releases") -> DataFrame:
    """Per release of a release manifest: its fields."""
    schema = T._parse_datatype_string(RELEASES.replace("releases array", f"{key} array"))
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(key))


def matching_release(found: DataFrame, version: str) -> DataFrame:
    """The newest release whose demo fits ``version``: equal, of the same three numbers, or below them. By numbers, not as text."""
    short = ".".join(version.split(".")[:3])
    fits = (F.col("demo_version") == version) | (F.col("demo_version") == short) | F.startswith(F.col("demo_version"), F.lit(f"{short}."))
    return found.filter(fits).orderBy(versions.order_key(F.col("demo_version")).desc()).limit(1)


def project_file(files: DataFrame) -> DataFrame:
    """Of files (path), the one that names a project's release: in its usual place first, then anywhere."""
    usual = ("Configuration/src/Configuration/Configuration.distr", "Configuration/src/Configuration/ParentConfigurations.bin")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rank = F.coalesce(*(F.when(F.col("path") == p, F.lit(i)) for i, p in enumerate(usual)), *(F.when(name == p.rsplit("/", 1)[-1], F.lit(i + 2)) for i, p in enumerate(usual)))
    ranked = files.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    return ranked.orderBy("_rank", "path").limit(1).drop("_rank")


def decoded(content: str | Column) -> Column:
    """Text of binary columns by the first encoding that fits."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(versions.decoded, na_action="ignore")

    return read(content)


def html_decoded(content: str | Column) -> Column:
    """Markup of binary columns, each by what ``html_text`` finds its encoding to be."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(html_text, na_action="ignore")

    return read(content)


def as_markdown(html: str | Column) -> Column:
    """Markdown of columns of markup."""

    @F.pandas_udf("string")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(markup.markdown, na_action="ignore")

    return write(html)


def html_text(content: bytes) -> str:
    """HTML by its byte-order mark, its declared character set, UTF-8, or else Windows-1251."""
    declared = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", content[:4096], re.I)
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    tries = [e for m, e in marks if content.startswith(m)] + ([declared[1].decode()] if declared else []) + ["utf-8", "cp1251"]
    for encoding in tries:
        try:
            return content.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return content.decode("utf-8", errors="replace")


def original(html: str, form: str = "markdown") -> str:
    """A page as it was, or as Markdown."""
    form = form.strip().lower()
    if form not in ("markdown", "html"):
        raise ValueError("the format must be markdown or html")
    return html if form == "html" else markup.markdown(html)


def zip_members(archives: DataFrame, content: str = "content") -> DataFrame:
    """Per member of the archives (path, content): archive, member, data; unsafe paths and links are errors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in members(archive):
                        found.append((path, info.filename, archive.read(info)))
                        size += info.file_size
                        if len(found) >= 1000 or size >= MEMBER_BYTES:
                            yield pd.DataFrame(found, columns=["archive", "member", "data"])
                            found, size = [], 0
        if found:
            yield pd.DataFrame(found, columns=["archive", "member", "data"])

    return archives.select("path", F.col(content).alias("content")).mapInPandas(read, "archive string, member string, data binary")


def versions_in(indexes: DataFrame) -> DataFrame:
    """The families that have an index, sorted."""
    return indexes.select("family").distinct().orderBy("family")
