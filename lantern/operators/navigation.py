"""The navigation catalogue: subsystems, their groups and methods; weighted discovery; section maps.

The catalogue is three flat tables. ``sections`` (name, description, keywords,
source_path, kinds, method_count), ``groups`` (id, subsystem, name, description,
keywords, interface_kind, source_prefix, method_count, evidence_methods,
confidence, source_hash) and ``methods`` (group_id, ord, method, purpose,
source_path). ``nested`` puts them together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import markup, text
from lantern.operators.scope import INTERFACE, MAIN_GROUP, OVERRIDE, ROOT
from lantern.sources.checkpoints import cut

#: Weights of a section's and a group's fields.
SECTION_WEIGHTS = {"name": 5.0, "description": 3.0, "keywords": 2.5}
GROUP_WEIGHTS = {"name": 3.0, "description": 2.0, "keywords": 3.0}
PARTIAL, PARTIAL_CHARS = 0.5, 5
NO_WORDS = "array<string>"


@dataclass
class Navigation:
    sections: DataFrame
    groups: DataFrame
    methods: DataFrame | None = None


def with_method(pages: DataFrame, html: str = "html", path: str = "source_path") -> DataFrame:
    """``pages`` with the method that a page describes, by its first heading or its file name, and its purpose."""

    @F.pandas_udf("heading string, lines array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            roots = [markup.parse(h or "") for h in htmls]
            found = [r.find("h1", "h2", "h3") for r in roots]
            yield pd.DataFrame({"heading": [n.text(" ") if n is not None else None for n in found], "lines": [r.text("\n").splitlines() for r in roots]}, dtype=object)

    stem = F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)
    seen = pages.withColumn("_read", read(html)).withColumn("method", F.coalesce(text.squash(F.col("_read.heading")), stem))
    lines = F.filter(F.transform("_read.lines", text.squash), lambda x: x != "")
    return seen.withColumn("purpose", text.purpose(lines, F.col("method"))).drop("_read")


def source_hash(methods: Column) -> Column:
    """sha256 of a group's methods written as JSON with sorted keys."""

    def quoted(value: Column) -> Column:
        """A JSON string: only quotes, backslashes and control characters are escaped."""
        named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = value
        for char, code in named.items():
            out = F.replace(out, F.lit(char), F.lit(code))
        rest = out
        for code in sorted({*range(32)} - {*map(ord, named)}):
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out), F.lit('"'))

    one = lambda m: F.concat(F.lit('{"method": '), quoted(m["method"]), F.lit(', "purpose": '), quoted(m["purpose"]), F.lit(', "source_path": '), quoted(m["source_path"]), F.lit("}"))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(methods, one), ", "), F.lit("]")), 256)


def build(pages: DataFrame) -> Navigation:
    """The catalogue of pages (source_path, html) below the program-interface root."""
    below = pages.filter(F.startswith(F.col("source_path"), F.lit(f"{ROOT}/")))
    parts = below.withColumn("p", F.split("source_path", "/")).withColumn("n", F.size("p"))
    part = lambda i: F.try_element_at("p", F.lit(i))
    placed = parts.select("source_path", "html", part(2).alias("subsystem"), part(3).alias("kind"), F.when(F.col("n") == 4, F.lit(MAIN_GROUP)).otherwise(part(4)).alias("group"), part(-1).alias("file"), "n")
    files = placed.filter((F.col("n") >= 4) & F.col("kind").isin(INTERFACE, OVERRIDE) & F.col("file").endswith(".html") & (F.lower("file") != "index.html"))
    seen = with_method(files)
    members = F.sort_array(F.collect_list(F.struct(F.lower("source_path").alias("ord"), "method", "purpose", "source_path")))
    grouped = seen.groupBy("subsystem", F.col("kind").alias("interface_kind"), F.col("group").alias("name")).agg(members.alias("methods"))
    prefix = F.when(F.col("name") == MAIN_GROUP, F.concat_ws("/", F.lit(ROOT), "subsystem", "interface_kind")).otherwise(F.concat_ws("/", F.lit(ROOT), "subsystem", "interface_kind", "name"))
    none = F.array().cast(NO_WORDS)
    groups = grouped.select(
        F.concat_ws("|", "subsystem", "interface_kind", "name").alias("id"),
        "subsystem",
        "name",
        F.lit("").alias("description"),
        none.alias("keywords"),
        "interface_kind",
        prefix.alias("source_prefix"),
        F.size("methods").alias("method_count"),
        none.alias("evidence_methods"),
        F.lit("").alias("confidence"),
        source_hash(F.col("methods")).alias("source_hash"),
        "methods",
    )
    counts = groups.groupBy("subsystem").agg(F.sum("method_count").alias("method_count"))
    kinds = placed.filter("n > 2").groupBy("subsystem").agg(*(F.max((F.col("kind") == k) & (F.col("n") > 3)).alias(f"has_{i}") for i, k in enumerate((INTERFACE, OVERRIDE))))
    present = F.filter(F.array(F.when(F.col("has_0"), F.lit(INTERFACE)), F.when(F.col("has_1"), F.lit(OVERRIDE))), lambda x: x.isNotNull())
    sections = kinds.join(counts, "subsystem", "left").select(F.col("subsystem").alias("name"), F.lit("").alias("description"), none.alias("keywords"), F.concat_ws("/", F.lit(ROOT), "subsystem").alias("source_path"), present.alias("kinds"), F.coalesce("method_count", F.lit(0)).alias("method_count"))
    methods = groups.select(F.col("id").alias("group_id"), F.posexplode("methods").alias("ord", "m")).select("group_id", "ord", "m.method", "m.purpose", "m.source_path")
    return Navigation(sections, groups.drop("methods"), methods)


def nested(navigation: Navigation) -> DataFrame:
    """Per section its groups and their methods, in catalogue order."""
    methods = navigation.methods.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("ord", "method", "purpose", "source_path"))).alias("methods"))
    kind = F.when(F.col("interface_kind") == INTERFACE, 0).otherwise(1)
    order = F.struct(kind.alias("kind"), (F.col("name") != MAIN_GROUP).alias("later"), F.lower("name").alias("name"))
    full = navigation.groups.join(methods, navigation.groups["id"] == methods["group_id"], "left")
    fields = [c for c in navigation.groups.columns if c != "subsystem"] + ["methods"]
    per = full.groupBy("subsystem").agg(F.sort_array(F.collect_list(F.struct(order.alias("ord"), F.struct(*fields).alias("group")))).alias("g"))
    both = navigation.sections.join(per, navigation.sections["name"] == per["subsystem"], "left")
    return both.select(*navigation.sections.columns, F.transform(F.coalesce("g", F.array()), lambda x: x["group"]).alias("groups"))


def _fields(columns: dict[str, float]) -> Column:
    """The fields' names, weights and words, as an array."""
    value = lambda c: F.array_join(F.col(c), " ") if c == "keywords" else F.col(c)
    return F.array(*(F.struct(F.lit(c).alias("field"), F.lit(w).alias("field_weight"), text.discovery_tokens(value(c)).alias("words")) for c, w in columns.items()))


def catalogue_words(navigation: Navigation) -> DataFrame:
    """Per word of a field: s (the subsystem), g (the group's id, null for the subsystem itself), field, field_weight, word."""
    own = navigation.sections.select(F.col("name").alias("s"), F.lit(None).cast("string").alias("g"), F.explode(_fields(SECTION_WEIGHTS)).alias("f"))
    groups = navigation.groups.select(F.col("subsystem").alias("s"), F.col("id").alias("g"), F.explode(_fields(GROUP_WEIGHTS)).alias("f"))
    return own.unionByName(groups).select("s", "g", "f.field", "f.field_weight", F.explode("f.words").alias("word"))


def token_weights(queries: DataFrame, words: DataFrame, sections: DataFrame) -> DataFrame:
    """Per token of a query: query_id, token, weight 1 + ln((N + 1) / (1 + df)) over the sections' words."""
    df = words.select("s", F.col("word").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = sections.count()
    tokens = queries.select("query_id", F.explode(text.without_stop_words(text.discovery_tokens(F.col("query")))).alias("token"))
    return tokens.join(df, "token", "left").select("query_id", "token", (1.0 + F.log((F.lit(n) + 1) / (1 + F.coalesce("df", F.lit(0))))).alias("weight"))


def substring_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(token, word) of which one is part of the other, both of ``PARTIAL_CHARS`` characters at least; ``left`` has distinct tokens, ``right`` distinct words.

    A q-gram index makes candidates by an equi-join: the first ``PARTIAL_CHARS`` characters of the shorter one are
    somewhere in the longer one. Only words that share them are compared.
    """
    long = lambda df, c: df.filter(F.length(c) >= PARTIAL_CHARS)
    first = lambda c: F.substring(c, 1, PARTIAL_CHARS).alias("gram")

    def grams(df: DataFrame, c: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.length(c) - PARTIAL_CHARS + 1)
        return df.select(c, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(PARTIAL_CHARS))))).alias("gram"))

    token, word = long(left, "token"), long(right, "word")
    inside = token.select("token", first("token")).join(grams(word, "word"), "gram").filter(F.contains("word", "token"))
    around = grams(token, "token").join(word.select("word", first("word")), "gram").filter(F.contains("token", "word"))
    return inside.select("token", "word").union(around.select("token", "word")).distinct()


def discover(queries: DataFrame, navigation: Navigation, limit: int = 5) -> DataFrame:
    """The best subsystems of each query (query_id, query): query_id, rank, name, description, score.

    A field scores each of the query's tokens that is one of its words in full, and one that a word holds or that holds a word by
    half. A section's score is that of its own fields and that of its best group, so that many weak groups don't
    outweigh a good one. Words meet by equi-joins, so only what matches is ever a row.
    """
    from lantern.operators.lexical import top

    if not 1 <= limit <= 20:
        raise ValueError("limit must be from 1 to 20")
    words = cut(catalogue_words(navigation))
    asked = cut(token_weights(queries, words, navigation.sections))
    tokens, known = asked.select("token").distinct(), words.select("word").distinct()
    exact = tokens.join(known, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("part"))
    pairs = exact.unionByName(substring_pairs(tokens, known).withColumn("part", F.lit(PARTIAL)))
    # a token counts once in a field, by its best word
    hits = pairs.join(words, "word").groupBy("s", "g", "field", "field_weight", "token").agg(F.max("part").alias("part"))
    scored = hits.join(asked, "token").groupBy("query_id", "s", "g").agg(F.sum(F.col("part") * F.col("field_weight") * F.col("weight")).alias("score"))
    whole = scored.groupBy("query_id", "s").agg((F.coalesce(F.max(F.when(F.col("g").isNull(), F.col("score"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("g").isNotNull(), F.col("score"))), F.lit(0.0))).alias("score"))
    named = whole.join(navigation.sections.select("name", "description"), F.col("s") == F.col("name"))
    ranked = named.select("query_id", F.lower("name").alias("section_id"), "name", "description", F.round("score", 9).alias("score")).filter("score > 0")
    return top(ranked, limit, F.col("score").desc()).drop("section_id")


def section_map(navigation: Navigation, subsystem: str) -> DataFrame:
    """One subsystem and its groups without methods; no rows if there is none of this name."""
    wanted = subsystem.strip().lower()
    groups = F.sort_array(F.collect_list(F.when(F.col("g_name").isNotNull(), F.struct(F.when(F.col("interface_kind") == INTERFACE, 0).otherwise(1).alias("k"), (F.col("g_name") != MAIN_GROUP).alias("later"), F.lower("g_name").alias("ord"), F.col("g_name").alias("name"), F.col("g_description").alias("description"), "interface_kind"))))
    found = navigation.sections.filter(F.lower("name") == wanted).select("name", "description")
    cards = navigation.groups.select("subsystem", F.col("name").alias("g_name"), F.col("description").alias("g_description"), "interface_kind")
    both = found.join(cards, F.col("name") == F.col("subsystem"), "left").groupBy("name", "description").agg(groups.alias("groups"))
    return both.select("name", "description", F.transform("groups", lambda g: F.struct(g["name"].alias("name"), g["description"].alias("description"), g["interface_kind"].alias("interface_kind"))).alias("groups"))
