"""The engine's tables as views of the given test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lantern.functions.text import FOLD_FROM, FOLD_TO
from lantern.operators import lexical
from lantern.operators.cells import Cells
from lantern.operators.navigation import Navigation
from lantern.sources.checkpoints import state

WORDS = r"[\p{L}\p{N}]+"
SEARCH_WORDS = r"[\p{L}\p{N}_.]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = 500) -> DataFrame:
    """``df`` in parts of about ``rows`` rows, whatever its files: a small file's rows may be much work."""
    return df.repartition(-(-df.count() // rows) or 1, key)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: the first line is the title; source and language are the breadcrumb."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.array("source", "lang").alias("breadcrumb"), "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("source_path"), "lang")


SECTIONS_SQL = """
sections AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source || ' > ' || lang AS breadcrumb, text, source || '/' || lang || '/' || doc_id AS source_path, lang FROM documents
)"""


def with_vectors(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``found``, with a vector where there is one."""
    return found.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


_INDEXES: dict[tuple, lexical.Index | Cells] = {}


def index(spark: SparkSession, sf_dir: str, weights: dict[str, float] = lexical.WEIGHTS) -> lexical.Index:
    """The full-text index of the sections, built once for a state of the table and a session."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, f"{sf_dir}/documents.parquet"), *weights)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.Index.build(sections(spark, sf_dir).select("id", *weights), weights=weights)
    return _INDEXES[key]


def cells(spark: SparkSession, sf_dir: str, of_sections: bool = False) -> Cells:
    """The cells of all vectors, or of those that sections have, built once for a state of the tables and a session."""
    names = ("embeddings", "documents") if of_sections else ("embeddings",)
    key = (spark.sparkContext.applicationId, sf_dir, *(state(spark, f"{sf_dir}/{name}.parquet") for name in names))
    if key not in _INDEXES:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        if of_sections:
            vectors = vectors.join(sections(spark, sf_dir).select("id"), "id", "left_semi")
        _INDEXES[key] = Cells.build(vectors)
    return _INDEXES[key]


def window(by: str, order: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as queries, with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vectors, "query_id")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector, against all of them."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def index_tokens_sql(value: str) -> str:
    return f"regexp_extract_all(translate(lower({value}), '{FOLD_FROM}', '{FOLD_TO}'), '{WORDS}')"


def bm25_sql(source: str, fields: dict[str, float], queries: str, name: str = "lexical") -> str:
    """CTEs that end in ``name`` (query_id, section_id, score); ``source`` has the sections, ``queries`` is a table expression (query_id, query)."""
    each = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {index_tokens_sql(f)} AS tokens FROM {source}" for f in fields)
    weights = " ".join(f"WHEN '{f}' THEN {w}" for f, w in fields.items())
    return f"""
fields AS ({each}),
occ AS (SELECT id, field, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM fields),
lens AS (SELECT id, CAST(sum(len(tokens)) AS DOUBLE) AS n FROM fields GROUP BY id),
stats AS (SELECT count(*) AS total, avg(n) AS mean FROM lens),
raw AS (SELECT query_id, unnest(regexp_extract_all(query, '{SEARCH_WORDS}')) AS word FROM {queries}),
asked AS (SELECT query_id, {index_tokens_sql("word")} AS phrase, count(*) AS times FROM raw GROUP BY ALL HAVING len(phrase) > 0),
parts AS (SELECT phrase, len(phrase) AS n, unnest(phrase) AS token, generate_subscripts(phrase, 1) AS k FROM (SELECT DISTINCT phrase FROM asked)),
hits AS (SELECT phrase, id, field, pos - k AS st FROM occ JOIN parts USING (token) GROUP BY phrase, n, id, field, st HAVING count(*) = n),
tf AS (SELECT phrase, id, CAST(sum(CASE field {weights} END) AS DOUBLE) AS f FROM hits GROUP BY phrase, id),
df AS (SELECT phrase, count(*) AS n FROM tf GROUP BY phrase),
idf AS (SELECT phrase, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM df, stats),
{name} AS (
  SELECT query_id, id AS section_id, round(-sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens.n / mean))), 9) AS score
  FROM tf JOIN idf USING (phrase) JOIN asked USING (phrase) JOIN lens USING (id), stats GROUP BY ALL
)"""


def top_sql(source: str, limit: int, order: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, section_id) AS INTEGER) AS rank FROM {source} QUALIFY rank <= {limit}"


def navigation(spark: SparkSession, sf_dir: str) -> Navigation:
    """A catalogue of parts: brands are subsystems, types their groups, words of names the keywords."""
    part = table(spark, sf_dir, "part")
    sections = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("description")).withColumn("keywords", F.array(F.col("description")))
    groups = part.groupBy(F.col("p_brand").alias("subsystem"), F.col("p_type").alias("name")).agg(F.max("p_name").alias("description"), F.sort_array(F.collect_set(F.substring_index("p_name", " ", 1))).alias("keywords"), F.count(F.lit(1)).alias("method_count"))
    return Navigation(sections, groups.withColumn("interface_kind", F.lit("Интерфейс")).withColumn("id", F.concat_ws("|", "subsystem", "interface_kind", "name")))


NAVIGATION_SQL = """
nav_sections AS (SELECT p_brand AS name, min(p_type) AS description, [min(p_type)] AS keywords FROM part GROUP BY p_brand),
nav_groups AS (
  SELECT p_brand AS subsystem, p_type AS name, max(p_name) AS description, list_sort(list(DISTINCT split_part(p_name, ' ', 1))) AS keywords, count(*) AS method_count
  FROM part GROUP BY ALL
)"""


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", "p_name", "p_type").alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
