"""Queries that run the engine itself, on documentation made of the test tables: scopes, catalogues, stores, trees, exports, crawls.

Suppliers are the pages of a documentation tree; nations are its subsystems.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import text, versions
from lantern.functions.urls import Site
from lantern.operators import documents, enrich, export, graph, hybrid, navigation, scope
from lantern.plans import tables as t
from lantern.sources import corpus, crawl
from lantern.sources.checkpoints import cut, delete, ensure_folder
from lantern.sources.store import Store
from lantern.streaming import ingest

QUERIES, SQL = {}, {}
RELEASE = "3.1.11.155"
KIND = f"CASE WHEN s_suppkey % 2 = 0 THEN '{scope.INTERFACE}' ELSE '{scope.OVERRIDE}' END"
GROUP = f"CASE WHEN s_suppkey % 3 = 0 THEN '{scope.MAIN_GROUP}' ELSE 'Group ' || s_suppkey % 3 END"
FOLDER = f"'{scope.ROOT}/' || n_name || '/' || {KIND} || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '/Group ' || s_suppkey % 3 END"
PURPOSE = "'Purpose \"of\" ' || s_name || ' \\ '"
HTML = f"'<html><body><p>before</p><h1 id=\"a' || s_suppkey || '\">' || s_name || '</h1><p>{{0}}</p><h3>Deep  ' || n_name || '</h3><ul><li>one</li><li>two</li></ul><h2></h2><pre>x</pre><h2>Second</h2><h1>Last</h1></body></html>'".format(f"' || {PURPOSE} || '")
#: Pages in SQL that Spark and DuckDB both understand.
PAGES = f"SELECT s_suppkey, n_name, {KIND} AS kind, {GROUP} AS grp, {FOLDER} AS folder, {FOLDER} || '/' || replace(s_name, '#', ' ') || '.html' AS source_path, s_name, {PURPOSE} AS purpose, {HTML} AS html FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("supplier", "nation"):
        t.table(spark, sf_dir, name).createOrReplaceTempView(f"engine_{name}")
    spark_sql = PAGES.replace("FROM supplier JOIN nation", "FROM engine_supplier JOIN engine_nation").replace("\\ ", "\\\\ ")
    return spark.sql(spark_sql)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_folder(spark)}/engine-{uuid.uuid4().hex}"


# --- sections of pages ---


@query(f"""WITH p AS ({PAGES}), h AS (
  SELECT source_path, s_suppkey, 1 AS k, 'a' || s_suppkey AS anchor, s_name AS title, [s_name] AS path, trim(purpose) AS body FROM p
  UNION ALL SELECT source_path, s_suppkey, 2, 'section-2', 'Deep ' || n_name, [s_name, 'Deep ' || n_name], 'one' || chr(10) || chr(10) || 'two' || chr(10) || chr(10) || 'x' FROM p
  UNION ALL SELECT source_path, s_suppkey, 3, 'section-3', 'Second', [s_name, 'Second'], 'Second' FROM p
  UNION ALL SELECT source_path, s_suppkey, 4, 'section-4', 'Last', ['Last'], 'Last' FROM p
)
SELECT substr(sha256('{RELEASE}' || chr(0) || source_path || chr(0) || anchor || chr(0) || '1' || chr(0) || body), 1, 24) AS id, source_path, anchor, title,
       'site > ' || array_to_string(path, ' > ') AS location, body AS text, CAST(1 AS INTEGER) AS part FROM h""")
def page_sections(spark, sf_dir):
    """Heading stacks with skipped levels, anchors and their fallback, blocks, parts and ids of whole pages."""
    pages = _pages(spark, sf_dir).select("source_path", F.array(F.lit("site")).alias("breadcrumb"), "html")
    return documents.sections(pages, RELEASE).select("id", "source_path", "anchor", "title", text.location(F.col("breadcrumb")).alias("location"), "text", "part")


@query(f"""WITH p AS ({PAGES}), h AS (
  SELECT source_path, 1 AS heading, 1 AS level, s_name AS title, 'a' || s_suppkey AS anchor, s_name AS path, [s_name, trim(purpose)] AS texts FROM p
  UNION ALL SELECT source_path, 2, 3, 'Deep ' || n_name, NULL, s_name || ' > Deep ' || n_name, ['Deep ' || n_name, 'one', 'two', 'x'] FROM p
  UNION ALL SELECT source_path, 3, 2, 'Second', NULL, s_name || ' > Second', ['Second'] FROM p
  UNION ALL SELECT source_path, 4, 1, 'Last', NULL, 'Last', ['Last'] FROM p
)
SELECT source_path, CAST(heading AS INTEGER) AS heading, CAST(level AS INTEGER) AS level, title, anchor, path, CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS block, unnest(texts) AS text FROM h""")
def html_blocks(spark, sf_dir):
    """Whole pages as rows of blocks by a table function, joined laterally."""
    found = documents.html_blocks(_pages(spark, sf_dir).select("source_path", "html"))
    return found.select("source_path", "heading", "level", "title", "anchor", F.array_join("path", " > ").alias("path"), "block", "text")


@query("""SELECT doc_id, CAST(k AS INTEGER) AS part, body FROM (
  SELECT doc_id, unnest(range(len(parts))) AS k, unnest(parts) AS body FROM (
    SELECT doc_id, CASE WHEN length(t) <= 800 THEN [t] ELSE list_filter(list_transform(range(0, greatest(len(t), 1), 800), lambda i: trim(t[i + 1:i + 800], ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') END AS parts FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL)
  )
)""")
def chunk_cut(spark, sf_dir):
    """Each text as one block, which is cut into slices where it has over 800 characters."""
    docs = t.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(documents.packed(F.array("text"), 800)).alias("part", "body"))


# --- text functions ---

FLAGGED = "coalesce(text, '') || CASE lang WHEN 'en' THEN ' Рекомендуется.' WHEN 'fr' THEN ' НЕ  рекомендуется' WHEN 'de' THEN ' рекомендуемый, устарело' ELSE ' рекомендуемость' END"


@query("SELECT doc_id, coalesce(lang IN ('en', 'fr', 'de'), false) AS recommends, coalesce(lang IN ('fr', 'de'), false) AS warns FROM documents")
def documentation_flags(spark, sf_dir):
    """What recommends and warns, by whole words, in documents that end in such words."""
    flagged = t.table(spark, sf_dir, "documents").select("doc_id", F.expr(FLAGGED).alias("text"))
    return flagged.select("doc_id", text.recommends(F.col("text")).alias("recommends"), text.warns(F.col("text")).alias("warns"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squashed, text[1:100] AS head FROM documents".replace("text[1:100]", "CASE WHEN regexp_replace(left({0}, 100), '[ .]+$', '') = '' THEN 'index' ELSE regexp_replace(left({0}, 100), '[ .]+$', '') END".format("coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[<>:\"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g'), ' .'), ''), 'index')")))
def bounded_names(spark, sf_dir):
    """Squashed texts, and names of at most 100 characters."""
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.squash(F.col("text")).alias("squashed"), text.bounded_name(F.col("text")).alias("head"))


@query(f"SELECT doc_id, 'Docs {RELEASE}' || chr(10) || 'Section: ' || source || ' > ' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Source: ' || source ELSE '' END || chr(10) || chr(10) || text AS embedding_text, 'Instruct: {text.INSTRUCTION}' || chr(10) || 'Query: ' || source AS query_text FROM documents")
def embedding_texts(spark, sf_dir):
    """What goes to the embedder for sections and for queries."""
    docs = t.table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return docs.select("doc_id", text.embedding_text("Docs", F.lit(RELEASE), F.array("source", "lang"), path, F.col("text")).alias("embedding_text"), text.query_text(F.col("source")).alias("query_text"))


STOPPED = " || ' ' || ".join(["p_name", *(f"'{w.upper()}'" for w in text.STOP_WORDS[::3])])


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(p_name, '[0-9A-Za-z]+'), lambda w: length(w) > 2), lambda w: lower(w)))), ' ') AS tokens FROM part")
def discovery_stop_words(spark, sf_dir):
    """Tokens of names among stop words."""
    tokens = text.without_stop_words(text.discovery_tokens(F.expr(STOPPED)))
    return t.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


# --- scopes ---

SCOPES = {"development": (("development", None, None), f"kind = '{scope.INTERFACE}'"), "subsystem": (("all", "france", None), "n_name = 'FRANCE'"), "group": (("override", "FRANCE", "Group 1"), f"n_name = 'FRANCE' AND kind = '{scope.OVERRIDE}' AND grp = 'Group 1'"), "main": (("all", "FRANCE", scope.MAIN_GROUP), f"n_name = 'FRANCE' AND grp = '{scope.MAIN_GROUP}'"), "main_override": (("override", "FRANCE", scope.MAIN_GROUP), f"n_name = 'FRANCE' AND kind = '{scope.OVERRIDE}' AND grp = '{scope.MAIN_GROUP}'")}


@query(f"WITH p AS ({PAGES}), n AS (SELECT min(n_name) AS one FROM p) " + " UNION ALL ".join(f"SELECT '{name}' AS scope, source_path FROM p, n WHERE {condition.replace(chr(39) + 'FRANCE' + chr(39), 'one')}" for name, (_, condition) in SCOPES.items()))
def scoped_sections(spark, sf_dir):
    """The pages that each kind of scope takes; the subsystem is the first by name."""
    pages = _pages(spark, sf_dir)
    one = pages.agg(F.min("n_name")).first()[0]
    given = lambda s: None if s is None else one.lower() if s.islower() else one
    each = (scope.scoped(pages, mode, given(subsystem), group).select(F.lit(name).alias("scope"), "source_path") for name, ((mode, subsystem, group), _) in SCOPES.items())
    out = next(each)
    for other in each:
        out = out.unionByName(other)
    return out


# --- the catalogue ---


def _navigation(spark, sf_dir) -> navigation.Navigation:
    return navigation.build(_pages(spark, sf_dir).select("source_path", "html"))


PREFIX = f"'{scope.ROOT}/' || n_name || '/' || kind || CASE WHEN grp = '{scope.MAIN_GROUP}' THEN '' ELSE '/' || grp END"


@query(f"WITH p AS ({PAGES}) SELECT n_name || '|' || kind || '|' || grp AS id, n_name AS subsystem, kind AS interface_kind, grp AS name, {PREFIX} AS source_prefix, CAST(count(*) AS INTEGER) AS method_count, sha256('[' || string_agg('{{\"method\": \"' || s_name || '\", \"purpose\": \"' || replace(replace(trim(purpose), '\\', '\\\\'), '\"', '\\\"') || '\", \"source_path\": \"' || source_path || '\"}}', ', ' ORDER BY lower(source_path)) || ']') AS source_hash FROM p GROUP BY n_name, kind, grp")
def nav_groups(spark, sf_dir):
    """Groups of a catalogue built from pages, with the digests of their methods."""
    return _navigation(spark, sf_dir).groups.select("id", "subsystem", "interface_kind", "name", "source_prefix", "method_count", "source_hash")


@query(f"WITH p AS ({PAGES}) SELECT n_name || '|' || kind || '|' || grp AS group_id, CAST(row_number() OVER (PARTITION BY n_name, kind, grp ORDER BY lower(source_path)) - 1 AS INTEGER) AS ord, s_name AS method, trim(purpose) AS purpose, source_path FROM p")
def nav_methods(spark, sf_dir):
    return _navigation(spark, sf_dir).methods.select("group_id", "ord", "method", "purpose", "source_path")


@query(f"WITH p AS ({PAGES}) SELECT n_name AS name, '{scope.ROOT}/' || n_name AS source_path, array_to_string(list_filter(['{scope.INTERFACE}', '{scope.OVERRIDE}'], lambda k: list_contains(list(DISTINCT kind), k)), ',') AS kinds, count(*) AS method_count FROM p GROUP BY n_name")
def nav_sections(spark, sf_dir):
    """The catalogue written as a navigation file and read again."""
    from lantern.__main__ import navigation_json

    base = _folder(spark)
    export.write_pages(t.spread(_pages(spark, sf_dir), "source_path").select(F.concat(F.lit("source/"), "source_path").alias("path"), F.col("html").alias("page")), base)
    written = [("navigation.json", navigation_json(spark, f"{base}/source", RELEASE))]
    export.write_pages(spark.createDataFrame(written, "path string, page string"), base)
    read = corpus.navigation_file(spark, f"{base}/navigation.json", RELEASE).select(F.explode("sections").alias("s"))
    out = cut(read.select("s.name", "s.source_path", F.array_join("s.kinds", ",").alias("kinds"), F.col("s.method_count").cast("long").alias("method_count")))
    delete(spark, base)
    return out


@query(f"WITH p AS ({PAGES}), g AS (SELECT DISTINCT n_name || '|' || kind || '|' || grp AS id FROM p), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM g) SELECT CAST(i // 20 + 1 AS INTEGER) AS batch, printf('g%02d', CAST(i % 20 + 1 AS INTEGER)) AS short_id, id FROM n")
def enrichment_requests(spark, sf_dir):
    """Groups in batches of 20 under short ids, as they are asked about."""
    nav = _navigation(spark, sf_dir)
    asked = enrich.requests(nav.groups, nav.methods, (enrich.GROUP_LIMITS[0], 1 << 40))
    ids = F.from_json("payload", "groups array<struct<id string>>")["groups"]["id"]
    pairs = F.explode(F.arrays_zip(ids.alias("short_id"), F.col("group_ids").alias("id")))
    return asked.select("batch", pairs.alias("p")).select("batch", F.col("p.short_id").alias("short_id"), F.col("p.id").alias("id"))


@query(f"WITH p AS ({PAGES}) SELECT n_name || '|' || kind || '|' || grp AS id, 'All about ' || n_name AS description, min(s_name) AS evidence, 'high' AS confidence FROM p GROUP BY n_name, kind, grp")
def enrichment_results(spark, sf_dir):
    """Groups with the cards that a model wrote, whose evidence is checked against the methods."""
    nav = _navigation(spark, sf_dir)
    evidence = F.array(F.min("method"))
    cards = nav.methods.groupBy(F.col("group_id").alias("id")).agg(F.concat(F.lit("All about "), F.substring_index(F.first("group_id"), "|", 1)).alias("description"), F.array(F.lit("one"), F.lit("two"), F.lit("three")).alias("keywords"), evidence.alias("evidence_methods"), F.lit("high").alias("confidence"))
    return enrich.enriched(nav.groups, nav.methods, cut(cards)).select("id", "description", F.col("evidence_methods")[0].alias("evidence"), "confidence")


# --- stores ---


@query("SELECT '3.1' AS family, '3.1.11.155' AS source_version, 'hashing' AS model, count(*) AS chunk_count, count(DISTINCT source || '/' || lang) AS source_file_count FROM documents")
def store_metadata(spark, sf_dir):
    """The metadata of an index that was built, published and opened."""
    store = Store(spark, base := _folder(spark))
    store.build(_stored(spark, sf_dir), hybrid.HashingEmbedder(), RELEASE)
    (family,) = store.families()
    store.check_model(family, hybrid.HashingEmbedder())
    out = cut(store.table(family, "metadata").select("family", "source_version", "model", "chunk_count", "source_file_count"))
    delete(spark, base)
    return out


def _stored(spark, sf_dir) -> DataFrame:
    found = t.sections(spark, sf_dir)
    return found.select(F.col("id").cast("string").alias("id"), F.lit(RELEASE).alias("source_version"), "title", "breadcrumb", F.concat_ws("/", "breadcrumb").alias("source_path"), "text")


@query(f"WITH {t.SECTIONS_SQL}, tok AS (SELECT id, unnest({t.index_tokens_sql('text')}) AS token FROM sections) SELECT token, CAST(id AS VARCHAR) AS section_id, count(*) AS tf FROM tok GROUP BY ALL")
def stored_postings(spark, sf_dir):
    """An index's postings of the text column, read back from a build."""
    store = Store(spark, base := _folder(spark))
    store.build(_stored(spark, sf_dir), hybrid.HashingEmbedder(), RELEASE)
    found = store.table("3.1", "postings").filter("field = 'text'")
    out = cut(found.select("token", "section_id", F.size("positions").cast("long").alias("tf")))
    delete(spark, base)
    return out


@query("SELECT user_id, CAST(arg_max(value, event_id) AS FLOAT) AS value FROM events GROUP BY user_id")
def query_cache(spark, sf_dir):
    """Vectors that were cached twice: the last one counts."""
    store = Store(spark, base := _folder(spark))
    events = t.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"))
    keyed = cut(events.select("user_id", F.col("user_id").cast("string").alias("cache_key"), "first", "last"))
    for c in ("first", "last"):
        store.cache(keyed.select("cache_key", F.array(c).alias("embedding")))
    out = cut(store.cached(keyed).join(keyed.select("user_id", "cache_key"), "cache_key").select("user_id", F.col("embedding")[0].alias("value")))
    delete(spark, base)
    return out


# --- bytes, project files and archives ---

SUPPORT = "'<?xml version=\"1.0\"?><d:DistributionSupport xmlns:d=\"x\">' || CASE s_suppkey % 3 WHEN 0 THEN '<parentConfigurationInfos configRelease=\"' || s_suppkey || '.02.' || s_nationkey || '\"/><parentConfigurationInfos configRelease=\"9.9\"/>' WHEN 1 THEN '<parentConfigurationInfos/>' ELSE '<other/>' END || '</d:DistributionSupport>'"
LEGACY = "'{\"7.1.1\",\"' || s_suppkey || '.0' || s_nationkey || '_x\",\"' || s_suppkey || '.0' || s_nationkey || '\",' || CASE WHEN s_suppkey % 4 > 0 THEN 'Library,' ELSE '' END || '\"8.8\",Library2}'"


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || '.2.' || s_nationkey END AS release, CASE s_suppkey % 3 WHEN 1 THEN 'a configuration without a release' WHEN 2 THEN 'no configuration in the support description' END AS failure, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey || '.' || s_nationkey ELSE '8.8' END AS quoted FROM supplier")
def project_versions(spark, sf_dir):
    """Releases that both kinds of project files name, and why one names none."""
    files = t.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(SUPPORT).alias("support"), F.expr(LEGACY).alias("legacy"))
    return files.select("s_suppkey", versions.from_support_xml(F.col("support")).alias("release"), versions.support_failure(F.col("support")).alias("failure"), versions.quoted_before(F.col("legacy"), "Library").alias("quoted"))


#: "<p>Страница " in Windows-1251.
PAGE_1251 = "3C703ED1F2F0E0EDE8F6E020"


@query("SELECT s_suppkey, '<p>Страница ' || s_name || CASE WHEN s_suppkey % 4 = 1 THEN '<meta charset=\"windows-1251\">' ELSE '' END AS html, '<p>Страница ' || s_name || '.' AS plain FROM supplier")
def decoded_pages(spark, sf_dir):
    """Pages in UTF-8 with and without a mark, UTF-16 and Windows-1251, declared or not, as text."""
    k, whole = F.col("s_suppkey") % 4, F.concat(F.lit("<p>Страница "), "s_name")
    legacy = F.concat(F.unhex(F.lit(PAGE_1251)), F.encode("s_name", "UTF-8"))
    declared = F.concat(legacy, F.encode(F.lit('<meta charset="windows-1251">'), "UTF-8"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(whole, "UTF-8"))
    content = F.when(k == 0, marked).when(k == 1, declared).when(k == 2, F.encode(whole, "UTF-16")).otherwise(F.encode(whole, "UTF-8"))
    # Windows-1251 is what is left for bytes of an odd number; even ones may be UTF-16
    end = F.encode(F.lit("."), "UTF-8")
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(F.concat(whole, F.lit(".")), "UTF-16LE"))
    other = F.when(k == 0, F.concat(marked, end)).when(k == 1, F.concat(legacy, end)).when(k == 2, wide).otherwise(F.concat(F.encode(whole, "UTF-8"), end))
    return t.table(spark, sf_dir, "supplier").select("s_suppkey", corpus.html_decoded(content).alias("html"), corpus.decoded(other).alias("plain"))


@query("SELECT s_suppkey, '# ' || s_name || chr(10) || chr(10) || 'A **bold** `word` of [' || s_name || '](x.htm).' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_suppkey || ' | y |' AS page FROM supplier")
def markdown_pages(spark, sf_dir):
    """Pages with emphasis, links, lists and tables as Markdown."""
    html = F.concat(F.lit("<html><head><title>t</title></head><body><h1>"), "s_name", F.lit("</h1><p>A <b>bold</b>\n <code>word</code> of <a href='x.htm'>"), "s_name", F.lit("</a>.</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td>y</td></tr></table></body></html>"))
    return t.table(spark, sf_dir, "supplier").select("s_suppkey", corpus.as_markdown(html).alias("page"))


@query("SELECT 'a' || s_suppkey AS archive, 'd/' || k || '.html' AS member, s_name || ' ' || k AS page FROM supplier, (VALUES (0), (1), (2)) AS n(k)")
def archive_members(spark, sf_dir):
    """The members of archives, one for each supplier, which tasks make."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            out = []
            for name in names:
                with zipfile.ZipFile(held := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.mkdir("d")
                    for k in range(3):
                        archive.writestr(f"d/{k}.html", f"{name} {k}")
                out.append(held.getvalue())
            yield pd.Series(out)

    archives = t.spread(t.table(spark, sf_dir, "supplier"), "s_suppkey").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("path"), packed("s_name").alias("content"))
    return corpus.zip_members(archives).select("archive", "member", F.decode("data", "UTF-8").alias("page"))


# --- trees, links and exports ---

SITE = Site("https://docs.example", ("/db/docs/content/src/", "/db/content/docs/src/"), "/db/content/docs/src/")
ADDRESS = "CASE p_partkey % 5 WHEN 0 THEN 'https://mirror.example/db/docs/content/src/' || replace(p_name, ' ', '%20') || '.HTM_?q=1#f' WHEN 1 THEN 'http://docs.example/db/content/docs/src/a/' || p_name || '.htm' WHEN 2 THEN 'https://docs.example/db/content/docs/src/x.png' WHEN 3 THEN 'https://docs.example/elsewhere/' || p_name || '.htm' ELSE '/db/docs/content/src/%D0%B9~' || p_size || '*+.htm' END"


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://docs.example/db/content/docs/src/' || replace(p_name, ' ', '%20') || '.HTM#_print' WHEN 1 THEN 'https://docs.example/db/content/docs/src/a/' || replace(p_name, ' ', '%20') || '.htm#_print'
WHEN 4 THEN 'https://docs.example/db/content/docs/src/%D0%B9~' || p_size || '%2A%2B.htm#_print' END AS page FROM part""")
def url_normalize(spark, sf_dir):
    """Addresses of all spellings as the pages that they mean."""
    return t.table(spark, sf_dir, "part").select("p_partkey", SITE.page(F.expr(ADDRESS)).alias("page"))


SITE_PAGES = """(SELECT 'https://docs.example/db/content/docs/src/n' || n_nationkey || '.htm#_print' AS url, n_nationkey AS k, n_regionkey AS r, n_name AS title FROM nation)"""


def _site(spark, sf_dir) -> DataFrame:
    """A page for each nation, with links to the next three, in two spellings, to itself and to other places."""
    n = t.table(spark, sf_dir, "nation")
    link = lambda form, step: F.format_string(form, (F.col("n_nationkey") + step) % 25)
    index = F.concat(F.lit('<div class="x index"><ul><li>'), link('<a href="n%d.htm#p">next</a>', 1), link('<a href="/db/docs/content/src/n%d.htm_">again</a>', 1), link('<a href="n%d.htm">third</a>', 3), F.lit("</li></ul></div>"))
    html = F.concat(F.lit("<html><head><title>no</title></head><body><h1>"), "n_name", F.lit("</h1>"), index, link('<p><a href="n%d.htm">second</a>', 2), link('<a href="n%d.htm">self</a>', 0), F.lit('<a href="https://other.example/y">out</a></p></body></html>'))
    return n.select(F.format_string("https://docs.example/db/content/docs/src/n%d.htm#_print", "n_nationkey").alias("url"), F.col("n_name").alias("title"), html.alias("html"))


@query(f"SELECT a.url AS src, b.url AS dst, CAST(CASE (b.k - a.k + 25) % 25 WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INTEGER) AS ord FROM {SITE_PAGES} a JOIN {SITE_PAGES} b ON (b.k - a.k + 25) % 25 IN (1, 2, 3)")
def site_links(spark, sf_dir):
    """Links within a site: canonical, once each, in order, none to the page itself."""
    return graph.links(_site(spark, sf_dir), SITE, "https://docs.example/db/content/docs/src/")


@query(f"SELECT a.url AS src, b.url AS dst, CAST(CASE (b.k - a.k + 25) % 25 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS ord FROM {SITE_PAGES} a JOIN {SITE_PAGES} b ON (b.k - a.k + 25) % 25 IN (1, 3)")
def index_links(spark, sf_dir):
    """Links of index blocks alone, to known pages."""
    pages = _site(spark, sf_dir)
    return graph.known_links(graph.links(pages, SITE, index_only=True), pages)


def _offline(html: dict[str, str]):
    """A fetch of the few pages of a site that is at hand."""

    def fetch(url: str) -> crawl.Fetched:
        return crawl.Fetched(200, html[url].encode()) if url in html else crawl.Fetched(404, b"")

    return fetch


@query(f"SELECT url, 'ok' AS status, title, CAST(3 AS INTEGER) AS n_children, 'pages/' || printf('%04d', CAST(row_number() OVER (ORDER BY url) AS INTEGER)) || '.html' AS file FROM {SITE_PAGES}")
def crawled_site(spark, sf_dir):
    """A crawl from one page over links with cycles, stopped after three pages and taken up again."""
    keep = _folder(spark)
    html = {r["url"]: r["html"] for r in _site(spark, sf_dir).collect()}  # 25 nations
    start = "https://docs.example/db/content/docs/src/n0.htm"
    crawl.crawl(spark, start, _offline(html), SITE, max_pages=3, keep=keep)
    pages = cut(crawl.numbered(crawl.crawl(spark, start, _offline(html), SITE, keep=keep)))
    delete(spark, keep)
    return pages.select("url", "status", "title", F.size("children").alias("n_children"), "file")


@query(f"SELECT url, title, CASE WHEN k = 7 THEN '' ELSE 'body ' || title END AS html FROM {SITE_PAGES} WHERE k % 5 > 0")
def crawl_manifest(spark, sf_dir):
    """The finished pages of a manifest that was written to files and read again."""
    base = _folder(spark)
    n = t.table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey"))
    file = F.concat(F.lit("pages/"), F.format_string("%04d", F.col("k").cast("int")), F.lit(".html"))
    done = {"url": F.format_string("https://docs.example/db/content/docs/src/n%d.htm#_print", "k"), "status": F.when(F.col("k") % 5 > 0, F.lit("ok")).otherwise(F.lit("error")), "title": F.col("n_name"), "file": F.when(F.col("k") % 5 > 0, file), "children": F.array().cast("array<string>")}
    fields = [c.split()[0] for c in corpus.PAGE.split(", ")]
    pages = n.select("k", *(done.get(c, F.lit(None).cast("string")).alias(c) for c in fields))
    export.write_pages(pages.filter("file IS NOT NULL").select(F.col("file").alias("path"), F.concat(F.lit("﻿"), F.when(F.col("k") == 7, F.lit("")).otherwise(F.concat(F.lit("body "), "title"))).alias("page")), base)
    export.write_pages(spark.createDataFrame([("manifest.json", crawl.manifest(pages, "s", "r"))], "path string, page string"), base)
    out = cut(corpus.crawled_pages(spark, f"{base}/manifest.json").select("url", "title", "html"))
    delete(spark, base)
    return out


@query(f"WITH p AS ({PAGES}) SELECT source_path, n_name AS subsystem, length(html) AS size FROM p")
def corpus_scan(spark, sf_dir):
    """A tree of files, read with its index pages left out."""
    base = _folder(spark)
    pages = _pages(spark, sf_dir)
    index = pages.select(F.concat("folder", F.lit("/index.html")).alias("path"), F.lit("<h1>index</h1>").alias("page")).distinct()
    export.write_pages(pages.select(F.col("source_path").alias("path"), F.col("html").alias("page")).unionByName(index), base)
    out = cut(corpus.scan(spark, base).select("source_path", F.col("breadcrumb")[1].alias("subsystem"), F.length("html").cast("long").alias("size")))
    delete(spark, base)
    return out


@query("""WITH RECURSIVE n AS (
  SELECT 'r' || r_regionkey AS url, NULL AS parent, r_name AS title, true AS linked FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, true FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Same / Name ' || s_suppkey % 3, true FROM supplier
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'gone' ELSE 's' || (SELECT min(s_suppkey) FROM supplier) END, c_name, false FROM customer
), heads AS (
  SELECT DISTINCT parent FROM n WHERE linked
), named AS (
  SELECT n.*, trim(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, h.parent IS NOT NULL AS leads, CAST(substr(url, 2) AS BIGINT) AS k FROM n LEFT JOIN heads h ON n.url = h.parent
), turned AS (
  SELECT *, CASE WHEN linked AND url LIKE 's%' AND row_number() OVER (PARTITION BY parent, lower(name), leads ORDER BY k) > 1 THEN name || '-' || substr(sha256(url), 1, 8) ELSE name END AS own FROM named
), w AS (
  SELECT url, own AS folder, own || '/index.html' AS path FROM turned WHERE parent IS NULL
  UNION ALL SELECT x.url, CASE WHEN leads THEN folder || '/' || own ELSE folder END, folder || '/' || own || CASE WHEN leads THEN '/index.html' ELSE '.html' END FROM w JOIN turned x ON x.parent = w.url
)
SELECT url, path FROM w UNION ALL SELECT url, 'Дополнительные материалы/' || own || '.html' FROM turned WHERE parent = 'gone'""")
def tree_paths(spark, sf_dir):
    """Paths of regions, their nations and their suppliers, many of one name; customers are linked by none, some have a recorded parent."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    first = t.table(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("k"))
    none = F.lit(None).cast("string")
    region = t.table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("url"), none.alias("parent"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("long").alias("k"))
    nation = t.table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("url"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("k"))
    supplier = t.table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("url"), key("n", "s_nationkey").alias("parent"), F.concat(F.lit("Same / Name "), (F.col("s_suppkey") % 3).cast("string")).alias("title"), F.col("s_suppkey").cast("long").alias("k"))
    customer = t.table(spark, sf_dir, "customer").crossJoin(F.broadcast(first)).select(key("c", "c_custkey").alias("url"), F.when(F.col("c_custkey") % 4 == 0, F.lit("gone")).otherwise(key("s", "k")).alias("parent"), F.col("c_name").alias("title"))
    linked = cut(region.unionByName(nation).unionByName(supplier))
    edges = linked.filter("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("url").alias("dst"), F.col("k").alias("ord"))
    pages = cut(linked.drop("k").unionByName(customer))
    return graph.tree_paths(pages, edges, region.select("url", F.col("k").alias("ord")))


ROW = '<tr><td><ol class="n"><li></li></ol></td><td>x</td></tr>'
NUMBERED = '<tr><td class="row-number">{}</td><td>x</td></tr>'
CHAPTER = f'<h1 id="{{0}}">{{1}}</h1><script>x()</script><div class="filter_place"><form>f</form></div><table>{ROW}{ROW}</table><p><a href="first">first</a> <a href="#here">here</a> <a href="http://h/x">out</a></p><nav> </nav>'


@query(f"""SELECT n_name AS title, n_name || '/index.html' AS path, replace('{export.page("@", "")}', '@', n_name)[:-15] || '<h1 id="' || CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation x WHERE x.n_regionkey = n.n_regionkey) THEN 'first' ELSE 'n' || n_nationkey END || '">' || n_name || '</h1><table>{NUMBERED.format(1)}{NUMBERED.format(2)}</table><p><a href="' || (SELECT n_name FROM nation x WHERE x.n_regionkey = n.n_regionkey ORDER BY n_nationkey LIMIT 1) || '/index.html">first</a> <a href="#here">here</a> <a href="http://h/x">out</a></p></main></body></html>' AS page FROM nation n""".replace("[:-15]", "[1:-22]"))
def chapter_pages(spark, sf_dir):
    """Documents split into chapters: numbered rows, no scripts, filters or empty containers, links between chapters."""
    n = t.table(spark, sf_dir, "nation").withColumn("turn", F.row_number().over(t.window("n_regionkey", "n_nationkey")))
    anchor = F.when(F.col("turn") == 1, F.lit("first")).otherwise(F.format_string("n%d", "n_nationkey"))
    one = F.replace(F.replace(F.lit(CHAPTER), F.lit("{0}"), anchor), F.lit("{1}"), F.col("n_name"))
    html = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("html")))), lambda x: x["html"]), "").alias("html"))
    return export.chapter_pages(html)


@query(f"SELECT a.url, a.title, 'p/' || a.title || '.html' AS path, (SELECT string_agg(b.title || '.html', ',' ORDER BY (b.k - a.k + 25) % 25) FROM {SITE_PAGES} b WHERE (b.k - a.k + 25) % 25 IN (1, 2, 3)) AS targets FROM {SITE_PAGES} a")
def crawled_export(spark, sf_dir):
    """Exported pages of a crawl, and where their links to one another lead."""
    pages = cut(_site(spark, sf_dir))
    paths = pages.select("url", F.concat(F.lit("p/"), "title", F.lit(".html")).alias("path"))
    out = export.rendered(pages, paths, SITE)
    found = F.regexp_extract_all("page", F.lit('href="([^"]*)">(?:next|second|third)<'), F.lit(1))
    order = F.transform(F.array(found[0], found[2], found[1]), lambda h: F.substring_index(h, "#", 1))
    return out.select("url", "title", "path", F.array_join(order, ",").alias("targets"))


# --- releases, streams ---


@query("SELECT DISTINCT '7.1.' || p_size % 4 || '.' || p_size AS demo_version, '7.1.' || p_size % 4 AS family FROM part WHERE p_size % 4 = 2 ORDER BY p_size DESC LIMIT 1".replace("SELECT DISTINCT", "SELECT"))
def release_manifest(spark, sf_dir):
    """The newest release that fits a version, of a manifest that was written and read again."""
    base = _folder(spark)
    sizes = [r[0] for r in t.table(spark, sf_dir, "part").select("p_size").distinct().collect()]  # 50 sizes
    releases = {"schema_version": 1, "releases": [{"documentation_version": "x", "index_family": f"7.1.{s % 4}", "demo_version": f"7.1.{s % 4}.{s}"} for s in sizes]}
    export.write_pages(spark.createDataFrame([("releases.json", json.dumps(releases))], "path string, page string"), base)
    found = corpus.matching_release(corpus.releases(spark, f"{base}/releases.json"), "7.1.2.999")
    out = cut(found.select("demo_version", F.col("index_family").alias("family")))
    delete(spark, base)
    return out


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_counts(spark, sf_dir):
    """Counts by hour of a stream of events."""
    source = f"{sf_dir}/events.parquet"
    return ingest.counted(spark, source).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
