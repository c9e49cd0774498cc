"""Exact dense ranking of batches of queries over cells of vectors.

Vectors are dealt to the cells of a k-means fit and laid out by cell and by distance from its centre; ``PACK`` neighbours
make a pack, which knows its own centre and radius. By the triangle inequality no vector of a pack scores more
than the centre's dot product with the query and the radius times the query's length. The best packs of
each query are scored first; the last of the first k scores that they reach is a threshold, and packs whose bound is
below it are never read. So the ranking is that of all vectors, whatever the fit is worth.

Queries are sent to the tasks in sets of ``SET``, and a task reads its packs one after another, ``PAGE`` vectors at once. Only the first k of
a page that reach the threshold leave it, so what moves are results, not vectors. What a task holds is bounded by these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators.lexical import MARGIN, SCORE_DIGITS, Best, top
from lantern.sources.checkpoints import cut, drop

#: Vectors that the fit is made from (those of lowest hash), its most cells, and its rounds.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 8
PACK, PAGE, BLOCK, SET = 256, 2048, 1024, 16_384
#: The least packs of each query that are scored before there is a threshold; with twice as many vectors as are wanted, if that is more.
FIRST = 2


def fit(vectors: np.ndarray) -> np.ndarray:
    """Centres of about twice the root of as many cells as there are vectors, by Lloyd's rounds."""
    n = min(CELLS, max(1, int(2 * len(vectors) ** 0.5)))
    centres = vectors[np.random.default_rng(0).choice(len(vectors), n, replace=False)]
    for _ in range(ROUNDS):
        nearest = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        sizes = np.bincount(nearest, minlength=n)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)


def _matrix(flat: pd.Series, dimension: int) -> np.ndarray:
    return np.concatenate([np.asarray(x, float) for x in flat]).reshape(-1, dimension)


@dataclass
class Cells:
    """``packs`` (pack, n, ids, vectors, centre, radius): ids and flat vectors of each pack."""

    packs: DataFrame
    dimension: int | None

    @classmethod
    def build(cls, sections: DataFrame, key: str = "id") -> Cells:
        rows = sections.filter("embedding IS NOT NULL").select(F.col(key).alias("section_id"), "embedding")
        sizes = [r[0] for r in rows.select(F.size("embedding")).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError(f"vectors of several dimensions: {sizes}")
        kind = dict(rows.dtypes)["section_id"]
        schema = f"pack long, n int, ids array<{kind}>, vectors array<float>, centre array<double>, radius double"
        if not sizes:
            return cls(rows.sparkSession.createDataFrame([], schema), None)
        sample = rows.orderBy(F.xxhash64("section_id"), "section_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        centres = fit(_matrix(sample, sizes[0]))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = _matrix(batch["embedding"], sizes[0])
                    cell = _nearest(v, centres)
                    yield batch.assign(cell=cell, far=np.linalg.norm(v - centres[cell], axis=1))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                all_ = [np.asarray(v, float).reshape(-1, sizes[0]) for v in batch["vectors"]]
                middle = [v.mean(0) for v in all_]
                yield batch.assign(centre=middle, radius=[np.linalg.norm(v - m, axis=1).max() for v, m in zip(all_, middle)])

        dealt = rows.mapInPandas(deal, f"section_id {kind}, embedding array<float>, cell int, far double")
        order = ["cell", "far", "section_id"]
        numbered = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        packed = numbered.groupBy("cell", F.floor(F.col("place") / PACK).alias("p")).agg(F.collect_list("section_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("vectors"))
        packs = packed.select(F.monotonically_increasing_id().alias("pack"), F.size("ids").alias("n"), "ids", "vectors")
        return cls(cut(packs.mapInPandas(measure, schema)), sizes[0])

    @classmethod
    def read(cls, packs: DataFrame) -> Cells:
        row = packs.select(F.size("centre")).first()
        return cls(packs, row[0] if row else None)

    def within(self, inside: DataFrame) -> Cells:
        """The cells with the vectors of ``inside`` (section_id) alone; their bounds stay true."""
        d = self.dimension
        if d is None:
            return self
        kept = self.packs.select("pack", F.posexplode("ids").alias("at", "section_id")).join(inside.select("section_id"), "section_id", "left_semi").groupBy("pack").agg(F.sort_array(F.collect_list("at")).alias("at"))
        ids = F.transform("at", lambda i: F.get("ids", i))
        found = F.flatten(F.transform("at", lambda i: F.slice("vectors", i * d + 1, d)))
        return Cells(cut(self.packs.join(kept, "pack").select("pack", F.size("at").alias("n"), ids.alias("ids"), found.alias("vectors"), "centre", "radius")), d)

    def nearest(self, queries: DataFrame, pool: int, farthest: bool = False) -> tuple[DataFrame, DataFrame]:
        """The ``pool`` nearest (or farthest) sections of each query (query_id, section_id, score, rank), and the (query_id, pack) that were read."""
        sizes = [r[0] for r in queries.select(F.size("embedding")).distinct().limit(2).collect()]
        d = self.dimension
        if sizes and d is not None and sizes != [d]:
            raise ValueError(f"queries of dimensions {sizes}, sections of {d}")
        asked = cut(queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q")))
        sets = -(-asked.count() // SET)
        out = [self._set_nearest(asked if sets == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == k), pool, farthest) for k in range(sets)] if d is not None else []
        drop(asked)
        if not (out := [r for r in out if r]):
            spark, q_kind = asked.sparkSession, dict(queries.dtypes)["query_id"]
            return spark.createDataFrame([], f"query_id {q_kind}, section_id {self._id_kind()}, score double, rank int"), spark.createDataFrame([], f"query_id {q_kind}, pack long")
        return tuple(reduce(DataFrame.unionByName, [r[k] for r in out]) for k in (0, 1))

    def _id_kind(self) -> str:
        return self.packs.schema["ids"].dataType.elementType.simpleString()

    def _set_nearest(self, asked: DataFrame, pool: int, farthest: bool) -> tuple[DataFrame, DataFrame] | None:
        """``nearest`` for one set of queries, which is sent to the tasks; None without any."""
        found = asked.toArrow().combine_chunks()
        size = self.packs.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if not found.num_rows or not size["packs"]:
            return None
        d, sign, q_kind, s_kind = self.dimension, -1.0 if farthest else 1.0, dict(asked.dtypes)["query_id"], self._id_kind()
        names, q = found["query_id"].combine_chunks(), sign * found["q"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        lengths = np.linalg.norm(q, axis=1)
        first = max(FIRST, -(-2 * pool * size["packs"] // max(1, size["n"])))
        scored = f"query_id {q_kind}, q int, section_id {s_kind}, score double"

        def flat(column: pa.Array) -> np.ndarray:
            return np.asarray(column.flatten(), float)

        def bounds_of(batch: pa.RecordBatch) -> np.ndarray:
            """By pack and query, what no score is above."""
            return flat(batch.column("centre")).reshape(-1, d) @ q.T + np.asarray(batch.column("radius"), float)[:, None] * lengths

        def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, step := max(1, PAGE // PACK)):
                    yield batch.slice(k, step)

        def bounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(first, len(q))
            for batch in pages(batches):
                bounds = bounds_of(batch)
                row, column = np.nonzero(bounds >= best.least(bounds))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(column)), pa.array(column.astype(np.int32)), batch.column("pack").take(pa.array(row)), pa.array(bounds[row, column])], ["query_id", "q", "section_id", "bound"])

        def firsts(scores: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the kept scores by query and vector (vectors by id): each query's first ``pool``; ties go by id."""
            if pool < scores.shape[1]:
                kept = kept & (scores >= np.partition(scores, -pool, axis=1)[:, -pool][:, None])
            for k in np.flatnonzero(kept.sum(1) > pool):
                at = np.flatnonzero(kept[k])
                kept[k, at[np.argsort(-scores[k, at], kind="stable")[pool:]]] = False
            return np.nonzero(kept)

        def products(batch: pa.RecordBatch, wanted: np.ndarray, least: np.ndarray, state: Best | None) -> Iterator[pa.RecordBatch]:
            """The first of each query among a page's vectors; ``wanted`` by pack and query."""
            ids, sizes = batch.column("ids").flatten(), np.asarray(pc.list_value_length(batch.column("ids")))
            order = np.asarray(pc.sort_indices(ids))
            v, pack = flat(batch.column("vectors")).reshape(-1, d)[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            ids = ids.take(pa.array(order))
            some = np.flatnonzero(wanted.any(0))
            for k in range(0, len(some), BLOCK):
                at = some[k : k + BLOCK]
                scores = np.round(q[at] @ v.T, SCORE_DIGITS) + 0.0
                scores[~wanted[pack][:, at].T] = -np.inf
                now = least[at]
                kept = (scores >= now[:, None]) & (scores > -np.inf)
                row, column = firsts(scores, kept)
                if state is not None and len(row):
                    state.take(at, scores)
                    least[at] = np.maximum(now, state.held[0, at])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at[row])), pa.array(at[row].astype(np.int32)), ids.take(pa.array(column)), pa.array(sign * scores[row, column] + 0.0)], ["query_id", "q", "section_id", "score"])

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pages(batches):
                wanted = np.zeros((batch.num_rows, len(q)), bool)
                for k, qs in enumerate(batch.column("qs").to_pylist()):
                    wanted[k, qs] = True
                yield from products(batch, wanted, np.full(len(q), -np.inf), None)

        order = F.col("score") if farthest else F.col("score").desc()
        ranked = lambda rows, keep: top(rows, pool, order).select(*keep)
        near = self.packs.select("pack", "centre", "radius").mapInArrow(bounding, f"query_id {q_kind}, q int, section_id long, bound double")
        near = cut(top(near, first, F.col("bound").desc()).select("query_id", "q", F.col("section_id").alias("pack")))
        met = near.groupBy("pack").agg(F.collect_list("q").alias("qs"))
        best = self.packs.select("pack", "ids", "vectors").join(met, "pack").mapInArrow(some, scored)
        reached = ranked(best, ("q", "score")).groupBy("q").agg(F.min(F.col("score") * sign).alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= pool).toArrow()
        least = np.full(len(q), -np.inf)
        least[reached["q"].to_numpy()] = reached["least"].to_numpy()

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state = least.copy(), Best(pool, len(q))
            for batch in pages(batches):
                yield from products(batch, bounds_of(batch) >= now - MARGIN, now, state)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pages(batches):
                row, column = np.nonzero(bounds_of(batch) >= least - MARGIN)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(column)), batch.column("pack").take(pa.array(row))], ["query_id", "pack"])

        read = near.select("query_id", "pack").unionByName(self.packs.select("pack", "centre", "radius").mapInArrow(pairs, f"query_id {q_kind}, pack long")).distinct()
        return cut(ranked(self.packs.mapInArrow(rest, scored), ("query_id", "section_id", "score", "rank"))), read
