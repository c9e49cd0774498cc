"""Queries of parsing, text, graph and catalogue operators over the test tables, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions import text, versions
from lantern.operators import documents, enrich, graph, numbering
from lantern.plans import tables as t
from lantern.sources import corpus
from lantern.sources.checkpoints import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _pages(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_path"), F.array(F.lit("site")).alias("breadcrumb"), "url", "html")


@query()
def html_sections(spark, sf_dir):
    """All pages as sections with ids and flags."""
    return documents.sections(_pages(spark, sf_dir), "3.1.11.155").drop("ord", "embedding_text")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INTEGER) AS n_headings FROM pages")
def html_headings(spark, sf_dir):
    return documents.headings(_pages(spark, sf_dir)).select("page_id", F.size("headings").alias("n_headings"))


@query("""SELECT page_id, CAST(ord AS INTEGER) AS ord, href FROM (
  SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS ord FROM (
    SELECT page_id, url, href, min(k) AS first FROM (
      SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS k FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
    ) WHERE href <> '' AND href <> url GROUP BY ALL
  )
)""")
def html_links(spark, sf_dir):
    """Each page's distinct links in order."""
    return graph.links(_pages(spark, sf_dir), keep=("page_id",)).select("page_id", "ord", F.col("dst").alias("href"))


CLEAN = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def clean_lines(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, substr(sha256('3.1.11.155' || chr(0) || source || chr(0) || 'section-1' || chr(0) || '1' || chr(0) || text), 1, 24) AS id FROM documents")
def chunk_ids(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", documents.section_id(F.lit("3.1.11.155"), F.col("source"), F.lit("section-1"), F.lit(1), F.col("text")).alias("id"))


@query("""WITH RECURSIVE b AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS blocks FROM documents
), e AS (
  SELECT doc_id, k, blocks[k] AS block FROM b, unnest(generate_series(1, len(blocks))) u(k)
), cut AS (
  SELECT doc_id, k, 0 AS i, block, false AS alone FROM e WHERE length(block) <= 8000
  UNION ALL SELECT doc_id, k, i, trim(block[i * 8000 + 1:(i + 1) * 8000], ' ' || chr(9) || chr(13)), true FROM e, unnest(range((length(block) + 7999) // 8000)) r(i) WHERE length(block) > 8000
), s AS (
  SELECT doc_id, block, alone, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS k FROM cut WHERE block <> ''
), w AS (
  SELECT doc_id, k, block AS open, alone, 1 AS part FROM s WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN j THEN open || chr(10) || chr(10) || block ELSE block END, s.alone, CASE WHEN j THEN part ELSE part + 1 END
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.k = w.k + 1, LATERAL (SELECT NOT w.alone AND NOT s.alone AND length(open) + 2 + length(block) <= 8000 AS j)
)
SELECT doc_id, CAST(part - 1 AS INTEGER) AS part, max_by(open, k) AS body FROM w GROUP BY doc_id, part""")
def chunk_pack(spark, sf_dir):
    """Lines packed greedily into parts of up to 8000 characters; longer lines are cut."""
    blocks = F.filter(F.split("text", "\n"), lambda x: x != "")
    return t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(documents.packed(blocks, 8_000)).alias("part", "body"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(nicht|sans)($|[^\\p{L}\\p{N}_])') AS negative FROM documents")
def flags(spark, sf_dir):
    """A flag by a word with Unicode boundaries, as recommendations and warnings are found."""
    return t.table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?iuU)\b(?:nicht|sans)\b").alias("negative"))


@query("SELECT DISTINCT source_path FROM (SELECT source || '/' || lang || '/' || doc_id || '.html' AS source_path FROM documents UNION ALL SELECT source || '/lonely' || (doc_id % 7) || '/index.html' FROM documents WHERE doc_id % 10 = 3)")
def index_suppression(spark, sf_dir):
    """Index pages of folders that hold other pages go; those alone in their folder stay."""
    docs = t.table(spark, sf_dir, "documents")
    name = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("source_path")
    leaves = docs.select(name(F.col("source"), "/", F.col("lang"), "/", F.col("doc_id").cast("string"), ".html"))
    aggregate = docs.select(name(F.col("source"), "/INDEX.html")).distinct().unionByName(docs.select(name(F.col("source"), "/", F.col("lang"), "/index.html")).distinct())
    lonely = docs.filter("doc_id % 10 = 3").select(name(F.col("source"), "/lonely", (F.col("doc_id") % 7).cast("string"), "/index.html")).distinct()
    return corpus.without_aggregates(leaves.unionByName(aggregate).unionByName(lonely)).select("source_path")


NAMES = "regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[<>:\"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g')"


@query(f"SELECT doc_id, CASE WHEN trim({NAMES}, ' .') = '' THEN 'index' ELSE trim({NAMES}, ' .') END AS name FROM documents")
def slugify(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", text.slug(F.substring_index("text", "\n", 1)).alias("name"))


RAW = "CASE WHEN s_suppkey % 5 = 0 THEN 'v' || s_suppkey ELSE ' 0' || (s_suppkey % 4) || '.' || s_nationkey || '_' || (s_suppkey % 13) || ' ' END"
FULL = "CASE WHEN regexp_full_match(trim(raw), '\\d+([._]\\d+)+') THEN array_to_string(list_transform(string_split(replace(trim(raw), '_', '.'), '.'), lambda p: CAST(CAST(p AS BIGINT) AS VARCHAR)), '.') END"


@query(f"WITH r AS (SELECT s_suppkey, {RAW} AS raw FROM supplier), f AS (SELECT s_suppkey, {FULL} AS full_version FROM r) SELECT s_suppkey, full_version, array_to_string(string_split(full_version, '.')[1:2], '.') AS family FROM f")
def version_parse(spark, sf_dir):
    s = t.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit("v"), key.cast("string"))).otherwise(F.concat(F.lit(" 0"), (key % 4).cast("string"), F.lit("."), F.col("s_nationkey").cast("string"), F.lit("_"), (key % 13).cast("string"), F.lit(" ")))
    full = versions.full(raw)
    return s.select("s_suppkey", full.alias("full_version"), versions.family(full).alias("family"))


EDGES = "edges AS (SELECT s_nationkey AS a, s_suppkey % 25 AS b FROM supplier UNION SELECT c_nationkey, (c_nationkey * 7 + c_custkey % 3) % 25 FROM customer)"


def _edges(spark, sf_dir):
    s = t.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") % 25).alias("b"))
    c = t.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 25).alias("b"))
    both = s.unionByName(c).distinct()
    return both.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.col("b").cast("int").alias("ord"))


@query(f"WITH RECURSIVE {EDGES}, w(n, level) AS (SELECT 0::BIGINT, 0 UNION SELECT b, level + 1 FROM w JOIN edges ON n = a WHERE level < 25) SELECT CAST(n AS VARCHAR) AS url, min(level) AS level FROM w GROUP BY n")
def bfs_levels(spark, sf_dir):
    """Breadth-first levels from nation 0 over links with cycles."""
    start = spark.range(1).select(F.lit("0").alias("url"))
    return graph.levels(_edges(spark, sf_dir), start).select("url", "level")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS url FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey * 5 FROM nation JOIN supplier ON s_nationkey = n_nationkey)")
def roots_antijoin(spark, sf_dir):
    """Nations that no supplier's link reaches: suppliers link to the first number of their region."""
    nodes = t.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("url"), F.col("n_name").alias("title"))
    region = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    links = t.table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").cast("string").alias("src"), (F.col("n_regionkey") * 5).cast("string").alias("dst"))
    return graph.roots(nodes, links).select("url")


@query("""WITH RECURSIVE items AS (
  SELECT source, list(n_chars ORDER BY doc_id) AS sizes FROM documents GROUP BY source
), w AS (
  SELECT source, 1 AS k, 1 AS batch, 1 AS n, sizes[1] AS size FROM items
  UNION ALL
  SELECT w.source, k + 1, CASE WHEN n >= 20 OR size + sizes[k + 1] > 75000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 20 OR size + sizes[k + 1] > 75000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 20 OR size + sizes[k + 1] > 75000 THEN sizes[k + 1] ELSE size + sizes[k + 1] END
  FROM w JOIN items USING (source) WHERE k < len(sizes)
)
SELECT source, CAST(batch AS INTEGER) AS batch, CAST(max(n) AS INTEGER) AS n_items, CAST(max(size) AS BIGINT) AS size FROM w GROUP BY source, batch""")
def greedy_batches(spark, sf_dir):
    """Each source's documents in order, in batches of up to 20 and 75000 characters."""
    docs = t.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    placed = numbering.batched(docs, ["doc_id"], "n_chars", 20, 75_000, "source")
    return placed.groupBy("source", "batch").agg(F.count(F.lit(1)).cast("int").alias("n_items"), F.sum("n_chars").alias("size"))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def evidence_antijoin(spark, sf_dir):
    """Labelled documents that aren't English: evidence beyond what is allowed."""
    allowed = t.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return enrich.unknown(t.table(spark, sf_dir, "labels").select("doc_id"), allowed, "doc_id")


@query("SELECT lang AS family, count(*) AS chunk_count, count(DISTINCT source) AS source_file_count FROM documents GROUP BY lang")
def corpus_metadata(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("family")).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("source").alias("source_file_count"))


@query("SELECT DISTINCT lang AS family FROM documents")
def versions_list(spark, sf_dir):
    return corpus.versions_in(t.table(spark, sf_dir, "documents").select(F.col("lang").alias("family")))


@query("SELECT source, sha256('[' || string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) || ']') AS digest, count(*) AS n FROM documents GROUP BY source")
def ordered_digest(spark, sf_dir):
    """A digest of each source's ids in order."""
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return t.table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12 AND NOT ends_with(x, '()') AND NOT (contains(x, '(') AND ends_with(x, ')')))[1], source)[1:500] AS purpose FROM documents")
def purpose_lines(spark, sf_dir):
    """The first meaningful line of each document."""
    return t.table(spark, sf_dir, "documents").select("doc_id", text.purpose(F.split("text", "\n"), F.col("source")).alias("purpose"))


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def query_cache_latest(spark, sf_dir):
    """The last value written for each key."""
    return t.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("SELECT count(*) FILTER (event_type = 'click') AS pages, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click' AND event_id >= 5000) AS fetched, count(*) FILTER (event_type = 'click' AND event_id < 5000) AS skipped FROM events")
def crawl_counters(spark, sf_dir):
    """Pages and errors of a crawl, and its pages by whether this run fetched them; events stand for pages, their ids for times."""
    status = F.when(F.col("event_type") == "click", F.lit("ok")).otherwise(F.col("event_type"))
    pages = t.table(spark, sf_dir, "events").select(status.alias("status"), F.format_string("%012d", "event_id").alias("fetchedAt"))
    return corpus.counters(pages, since=f"{5000:012d}")


@query("SELECT p_brand || '.' || p_size AS demo_version FROM part WHERE p_brand = 'Brand#7' ORDER BY p_size DESC LIMIT 1")
def release_match(spark, sf_dir):
    """The newest release of a family, by numbers."""
    part = t.table(spark, sf_dir, "part").select(F.concat(F.lit("7.1.2."), F.col("p_size").cast("string")).alias("demo_version")).where(F.col("p_brand") == "Brand#7")
    found = corpus.matching_release(part, "7.1.2.999")
    return found.select(F.concat(F.lit("Brand#7."), F.element_at(F.split("demo_version", r"\."), -1)).alias("demo_version"))


@query("SELECT DISTINCT lower(source) || '/' || lang AS location, count(*) OVER (PARTITION BY source, lang) AS n FROM documents")
def breadcrumb_merge(spark, sf_dir):
    """Breadcrumbs without parts that repeat the one before, whatever their case."""
    docs = t.table(spark, sf_dir, "documents")
    path = documents.merged_breadcrumb(F.array(F.lower("source")), F.array(F.upper("source"), F.col("lang"), F.upper("lang")))
    return docs.groupBy(F.array_join(path, "/").alias("location")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark, sf_dir):
    """Events by hour and type."""
    events = t.table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT page_id FROM pages")
def incremental_ingest(spark, sf_dir):
    """Pages ingested as a stream in two runs; the second finds nothing new."""
    from lantern.streaming import ingest

    return cut(ingest.replay(spark, f"{sf_dir}/pages.parquet", "page_id"))
