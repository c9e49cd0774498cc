"""Dense ranking, reciprocal-rank fusion, and the scoped hybrid search of a batch of queries."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text, vectors
from lantern.operators import lexical
from lantern.operators.cells import Cells

RANK_OFFSET = 60
EXCERPT, SHORT_EXCERPT = 1500, 600
BATCH = 32
#: Environment variables that name a provider of vectors.
PROVIDER_URL, PROVIDER_MODEL, PROVIDER_KEY = "LANTERN_EMBEDDINGS_URL", "LANTERN_EMBEDDINGS_MODEL", "LANTERN_EMBEDDINGS_KEY"


class Embedder(Protocol):
    """Whoever turns texts into vectors; ``model`` names what an index was built with."""

    model: str

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_queries(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic vectors without a provider: signed hashes of words, at unit length."""

    def __init__(self, dimension: int = 64, model: str = "hashing"):
        self.dimension, self.model = dimension, model

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts, strict=True):
            for word in t.lower().split() or [""]:
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
            row[0] += 0 if row.any() else 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()

    embed_queries = embed_documents


class Provider:
    """Vectors from an HTTP service that takes ``{"model", "input"}`` and returns ``{"data": [{"index", "embedding"}]}``.

    Queries go with an instruction. It is sent to workers as it is, so each asks on its own.
    """

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 120.0, instruction: str = text.INSTRUCTION):
        self.url, self.model, self.key, self.timeout, self.instruction = url, model, key, timeout, instruction

    @classmethod
    def from_environment(cls) -> Provider:
        return cls(os.environ[PROVIDER_URL], os.environ.get(PROVIDER_MODEL, ""), os.environ.get(PROVIDER_KEY, ""))

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urlopen(Request(self.url, body, headers), timeout=self.timeout) as response:
            return ordered_response(json.load(response)["data"], len(texts))

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self.embed_documents([text.INSTRUCTED.format(self.instruction, t) for t in texts])


def ordered_response(items: list[dict], expected: int) -> list[list[float]]:
    """A provider's vectors in the order of the request, at unit length; errors if any is missing or zero."""
    if sorted(x["index"] for x in items) != list(range(expected)):
        raise ValueError(f"asked for {expected} vectors, got {len(items)}, or not one for each")
    v = np.array([x["embedding"] for x in sorted(items, key=lambda x: x["index"])], float)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    if not norms.all():
        raise ValueError("a vector of zeros has no direction")
    return (v / norms).tolist()


def embedded(df: DataFrame, embedder: Embedder, column: str, into: str = "embedding", queries: bool = False) -> DataFrame:
    """``df`` with vectors of ``column``, asked for in batches of ``BATCH`` texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = embedder.embed_queries if queries else embedder.embed_documents
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), BATCH):
                out += ask(texts[k : k + BATCH].tolist())
            yield pd.Series(out)

    return df.withColumn(into, embed(column))


def pool_of(limit: int) -> int:
    """How many candidates each ranker gives."""
    return max(limit * 5, 50)


def fused(*rankings: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, section_id, rank): the sum of 1 / (60 + rank)."""
    every = rankings[0].select("query_id", "section_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "section_id", "rank"))
    return every.groupBy("query_id", "section_id").agg(F.sum(1.0 / (RANK_OFFSET + F.col("rank"))).alias("score"))


def search(queries: DataFrame, sections: DataFrame, index: lexical.Index, cells: Cells, limit: int = 8, scope: Column | None = None, key: str = "id") -> DataFrame:
    """The best sections of each query (query_id, query, embedding): query_id, rank, section_id, score and their fields.

    Sections without a vector are ranked by words alone. Both rankers see the scope before they rank; BM25 takes its statistics from
    all sections. Texts are joined only to the sections that are returned.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must be from 1 to 20")
    inside, pool = sections if scope is None else sections.filter(scope), pool_of(limit)
    ids = None if scope is None else inside.select(F.col(key).alias("section_id"))
    first = lexical.top(lexical.search(queries, index, pool, ids), pool, F.col("score"))
    second = (cells if ids is None else cells.within(ids)).nearest(queries, pool)[0]
    best = lexical.top(fused(first, second), limit, F.col("score").desc())
    return best.join(sections.drop("embedding"), F.col("section_id") == sections[key])


def projected(found: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """Results as they are returned: excerpt, location and rounded score."""
    extra = [c for c in ("has_recommendation", "has_warning", "source_path", "anchor", "part") if c in found.columns]
    return found.select("query_id", "rank", "section_id", "title", text.location(F.col("breadcrumb")).alias("location"), text.excerpt(F.col("text"), limit).alias("excerpt"), F.round("score", 8).alias("score"), *extra)


def compact(found: DataFrame) -> DataFrame:
    """Short results; flags are there only where they hold."""
    short = projected(found, SHORT_EXCERPT)
    flags = [F.when(F.col(c), F.lit(True)).alias(c) for c in ("has_recommendation", "has_warning") if c in short.columns]
    return short.select("query_id", "rank", F.col("section_id").alias("id"), "title", "location", "excerpt", *flags)
