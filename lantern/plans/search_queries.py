"""Search queries over the test tables, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions import text, vectors
from lantern.operators import health, hybrid, lexical, navigation
from lantern.plans import tables as t

QUERIES, SQL = {}, {}
WEIGHTED = lexical.WEIGHTS
TEXT_ONLY = {"text": 1.0}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _ranked(found, score_digits=6):
    return found.select("query_id", "rank", "section_id", F.round("score", score_digits).alias("score"))


ASKED = "(SELECT item_id AS query_id, text AS query FROM benchmark)"
RANKED = "SELECT query_id, rank, section_id, round(score, 6) AS score FROM"


@query(f"WITH {t.SECTIONS_SQL}, {t.bm25_sql('sections', TEXT_ONLY, ASKED)} {RANKED} ({t.top_sql('lexical', 10, 'score')})")
def bm25_topk(spark, sf_dir):
    found = lexical.search(t.text_queries(spark, sf_dir), t.index(spark, sf_dir, TEXT_ONLY), 10)
    return _ranked(lexical.top(found, 10, F.col("score")))


@query(f"WITH {t.SECTIONS_SQL}, {t.bm25_sql('sections', WEIGHTED, ASKED)} {RANKED} ({t.top_sql('lexical', 10, 'score')})")
def bm25_weighted_fields(spark, sf_dir):
    found = lexical.search(t.text_queries(spark, sf_dir), t.index(spark, sf_dir), 10)
    return _ranked(lexical.top(found, 10, F.col("score")))


@query(f"WITH {t.SECTIONS_SQL}, {t.bm25_sql('sections', WEIGHTED, ASKED)}, inside AS (SELECT lexical.* FROM lexical JOIN sections ON section_id = id WHERE lang = 'en') {RANKED} ({t.top_sql('inside', 10, 'score')})")
def bm25_scoped_global_stats(spark, sf_dir):
    """Statistics are those of all sections; the scope only filters."""
    inside = t.sections(spark, sf_dir).filter("lang = 'en'").select(F.col("id").alias("section_id"))
    found = lexical.search(t.text_queries(spark, sf_dir), t.index(spark, sf_dir), 10, inside)
    return _ranked(lexical.top(found, 10, F.col("score")))


PAIRS = r"(SELECT item_id AS query_id, regexp_replace(regexp_extract(text, '^\S+\s+\S+'), '\s+', '_') AS query FROM benchmark)"


@query(f"WITH {t.SECTIONS_SQL}, {t.bm25_sql('sections', WEIGHTED, PAIRS)} SELECT query_id, section_id, round(score, 6) AS score FROM lexical")
def phrase_match(spark, sf_dir):
    """The first two words of each passage as one phrase, in all sections."""
    pairs = t.text_queries(spark, sf_dir).withColumn("query", F.regexp_replace(F.regexp_extract("query", r"^\S+\s+\S+", 0), r"\s+", "_"))
    return lexical.search(pairs, t.index(spark, sf_dir)).select("query_id", "section_id", F.round("score", 6).alias("score"))


DENSE = "dense AS (SELECT q.vec_id AS query_id, v.vec_id AS section_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0{})"


@query(f"WITH {DENSE.format('')} {RANKED} ({t.top_sql('dense', 10, 'score DESC')})")
def dense_topk(spark, sf_dir):
    return _ranked(t.cells(spark, sf_dir).nearest(t.vector_queries(spark, sf_dir), 10)[0])


@query(f"WITH {DENSE.format(' AND v.label IN (1, 3, 5)')} {RANKED} ({t.top_sql('dense', 10, 'score DESC')})")
def dense_scoped_topk(spark, sf_dir):
    inside = t.table(spark, sf_dir, "embeddings").filter("label IN (1, 3, 5)").select(F.col("vec_id").alias("section_id"))
    return _ranked(t.cells(spark, sf_dir).within(inside).nearest(t.vector_queries(spark, sf_dir), 10)[0])


HYBRID_BASE = f"""{t.SECTIONS_SQL},
vectors AS (SELECT sections.*, embedding FROM sections LEFT JOIN embeddings ON id = vec_id),
asked_both AS (SELECT item_id AS query_id, text AS query, embedding FROM benchmark JOIN embeddings ON item_id = vec_id)"""


def _hybrid_sql(scope: str, select: str, limit: int = 8) -> str:
    pool = hybrid.pool_of(limit)
    return f"""WITH {HYBRID_BASE}, {t.bm25_sql("vectors", WEIGHTED, "asked_both")},
inside AS (SELECT lexical.* FROM lexical JOIN vectors ON section_id = id WHERE {scope}),
dense AS (SELECT q.query_id, v.id AS section_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM vectors v, asked_both q WHERE v.embedding IS NOT NULL AND {scope}),
r AS (SELECT query_id, section_id, rank FROM ({t.top_sql("inside", pool, "score")}) UNION ALL SELECT query_id, section_id, rank FROM ({t.top_sql("dense", pool, "score DESC")})),
fused AS (SELECT query_id, section_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r GROUP BY ALL),
best AS ({t.top_sql("fused", limit, "score DESC")})
SELECT {select} FROM best JOIN vectors ON section_id = id"""


FULL = "query_id, rank, section_id, title, breadcrumb AS location, CASE WHEN length(text) > {0} THEN left(text, {0}) || '…' ELSE text END AS excerpt, round(score, 8) AS score, source_path"


def _searched(spark, sf_dir, scope=None, limit=8):
    return hybrid.search(t.queries(spark, sf_dir), t.sections(spark, sf_dir), t.index(spark, sf_dir), t.cells(spark, sf_dir, of_sections=True), limit, scope)


@query(_hybrid_sql("true", FULL.format(hybrid.EXCERPT)))
def hybrid_search(spark, sf_dir):
    """Both rankers, fused, for the whole batch of queries."""
    return hybrid.projected(_searched(spark, sf_dir))


@query(_hybrid_sql("lang IN ('en', 'fr')", FULL.format(hybrid.EXCERPT)))
def hybrid_search_scoped(spark, sf_dir):
    """The scope holds before either ranker ranks."""
    return hybrid.projected(_searched(spark, sf_dir, F.col("lang").isin("en", "fr")))


@query(_hybrid_sql("true", "query_id, rank, section_id AS id, title, breadcrumb AS location, CASE WHEN length(text) > 600 THEN left(text, 600) || '…' ELSE text END AS excerpt", 20))
def result_projection(spark, sf_dir):
    return hybrid.compact(_searched(spark, sf_dir, limit=20))


@query(f"""WITH {DENSE.format("")}, a AS ({t.top_sql("dense", 50, "score DESC")}), b AS ({t.top_sql("dense", 50, "score")}),
r AS (SELECT query_id, section_id, rank FROM a UNION ALL SELECT query_id, section_id, rank FROM b)
SELECT query_id, section_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM r GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    """Fusion of the nearest and the farthest vectors, all rows."""
    asked, cells = t.vector_queries(spark, sf_dir), t.cells(spark, sf_dir)
    return hybrid.fused(cells.nearest(asked, 50)[0], cells.nearest(asked, 50, farthest=True)[0]).select("query_id", "section_id", F.round("score", 8).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, 1.0::DOUBLE AS unit, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings")
    unit = vectors.normalised(vectors.of_dimension(F.col("embedding"), 64))
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.norm(unit), 5).alias("unit"), F.size(unit).alias("dimension"))


@query(f"WITH {t.SECTIONS_SQL}, tok AS (SELECT id, unnest({t.index_tokens_sql('text')}) AS token FROM sections) SELECT token, count(DISTINCT id) AS df, count(*) AS tf FROM tok GROUP BY token")
def token_df(spark, sf_dir):
    """Document and collection frequency of every token."""
    # texts are dealt by id before they are taken apart, so only counts by token are shuffled
    dealt = t.sections(spark, sf_dir).select("id", "text").repartition("id")
    found = dealt.select("id", F.explode(text.index_tokens(F.col("text"))).alias("token"))
    return found.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count("id").alias("df"), F.sum("n").alias("tf"))


@query(f"WITH {t.SECTIONS_SQL}, l AS (SELECT lang, len({t.index_tokens_sql('title')}) + len({t.index_tokens_sql('breadcrumb')}) + len({t.index_tokens_sql('text')}) AS n FROM sections) SELECT lang, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS BIGINT) AS longest FROM l GROUP BY lang")
def doc_length_stats(spark, sf_dir):
    sections = t.sections(spark, sf_dir)
    found = lexical.lengths(sections).join(sections.select(F.col("id").alias("section_id"), "lang"), "section_id")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))


_WORDS = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '[0-9A-Za-zА-Яа-яЁё]+'), lambda w: length(w) > 2), lambda w: lower(w)))"


def _score_sql(value: str, weight: float) -> str:
    words = _WORDS.format(value)
    near = f"len(list_filter({words}, lambda w: length(a.token) >= 5 AND length(w) >= 5 AND (contains(w, a.token) OR contains(a.token, w)))) > 0"
    return f"{weight} * CASE WHEN list_contains({words}, a.token) THEN a.weight WHEN {near} THEN a.weight * 0.5 ELSE 0 END"


@query(f"""WITH {t.NAVIGATION_SQL},
words AS (
  SELECT name AS s, unnest({_WORDS.format("concat_ws(' ', name, description, array_to_string(keywords, ' '))")}) AS token FROM nav_sections
  UNION SELECT subsystem, unnest({_WORDS.format("concat_ws(' ', name, description, array_to_string(keywords, ' '))")}) FROM nav_groups
), df AS (SELECT token, count(DISTINCT s) AS df FROM words GROUP BY token),
q AS (SELECT DISTINCT p_name || ' ' || p_type AS query_id FROM part),
tok AS (SELECT DISTINCT query_id, unnest({_WORDS.format("query_id")}) AS token FROM q),
a AS (SELECT query_id, token, 1 + ln(((SELECT count(*) FROM nav_sections) + 1)::DOUBLE / (1 + coalesce(df, 0))) AS weight FROM tok LEFT JOIN df USING (token) WHERE token NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})),
own AS (SELECT query_id, name, any_value(description) AS description, sum({" + ".join(_score_sql("array_to_string(keywords, ' ')" if c == "keywords" else c, w) for c, w in navigation.SECTION_WEIGHTS.items())}) AS own FROM nav_sections, a GROUP BY query_id, name),
grp AS (SELECT query_id, subsystem, name, sum({" + ".join(_score_sql("array_to_string(keywords, ' ')" if c == "keywords" else c, w) for c, w in navigation.GROUP_WEIGHTS.items())}) AS g FROM nav_groups, a GROUP BY ALL),
best AS (SELECT query_id, subsystem, max(g) AS g FROM grp GROUP BY ALL),
total AS (SELECT own.query_id, own.name, description, round(own + coalesce(g, 0), 9) AS score FROM own LEFT JOIN best ON own.query_id = best.query_id AND own.name = subsystem)
SELECT query_id, name, description, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name)) AS INTEGER) AS rank FROM total WHERE score > 0 QUALIFY rank <= 5""")
def discovery_rank(spark, sf_dir):
    found = navigation.discover(t.part_queries(spark, sf_dir), t.navigation(spark, sf_dir))
    return found.select("query_id", "name", "description", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {t.NAVIGATION_SQL} SELECT s.name, s.description, g.name AS group_name, g.description AS group_description FROM nav_sections s JOIN nav_groups g ON s.name = g.subsystem WHERE lower(s.name) = 'brand#7'")
def section_map(spark, sf_dir):
    found = navigation.section_map(t.navigation(spark, sf_dir), " BRAND#7 ")
    return found.select("name", "description", F.explode("groups").alias("g")).select("name", "description", F.col("g.name").alias("group_name"), F.col("g.description").alias("group_description"))


@query(f"WITH {t.NAVIGATION_SQL} SELECT name, description FROM nav_sections")
def list_sections(spark, sf_dir):
    return t.navigation(spark, sf_dir).sections.select("name", "description")


@query(f"WITH {t.NAVIGATION_SQL} SELECT subsystem AS name, count(*) AS n_groups, CAST(sum(method_count) AS BIGINT) AS method_count FROM nav_groups GROUP BY subsystem")
def nav_build_counts(spark, sf_dir):
    return t.navigation(spark, sf_dir).groups.groupBy(F.col("subsystem").alias("name")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("method_count").alias("method_count"))


@query(f"WITH {t.SECTIONS_SQL}, {t.bm25_sql('sections', WEIGHTED, ASKED)}, top AS ({t.top_sql('lexical', 8, 'score')}) SELECT query_id, query_id * 7 AS expected FROM {ASKED} q WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = q.query_id AND section_id = q.query_id * 7)")
def canary_check(spark, sf_dir):
    """Canaries whose expected section isn't among their first 8."""
    asked = t.text_queries(spark, sf_dir)
    found = lexical.top(lexical.search(asked, t.index(spark, sf_dir), 8), 8, F.col("score"))
    return health.failures(asked.select("query_id", (F.col("query_id") * 7).alias("expected")), found)
