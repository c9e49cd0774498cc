"""Operator 13, phrase collocations, from tries of bounded depth that tasks count and Spark merges by prefix range.

A first pass over the texts counts words and pairs, a second one the pairs' branches of three words. A task counts its texts in a trie, one
for each language, and gives it away, sorted, whenever its texts have ``SHARD_WORDS`` words: rows of (lang, path, n). A
range partitioning by path merges all tries: a range holds neighbouring prefixes, its runs are merged by an external sort, and a
frequent word's branches go to as many ranges as they need. Nodes of fewer than ``least`` occurrences end there. No phrase
that has a rarer part can have ``least`` occurrences, so the second pass counts those phrases alone both of whose pairs stayed. It
asks a bitmap of ``FILTER_BITS`` bits for that, whose size doesn't depend on the input: phrases that share a bit by chance are
counted as well and end when they are merged, none is lost.

The nodes that stay are laid out by prefix range once more, and a walk over each range, in order, gives every node
the counts of its ancestors, the left parts of its cuts; the ancestors of a range's first node, at most two for a range, are
looked up before. Suffix links give the right parts: a node of three words links to that of its last two, which links to
that of its last. All nodes that end in one word link to the same node; where these are many, that node is broadcast.

Defined results: texts are lower-cased in A-Z, null texts are empty, a null language is ``und``. Empty texts count nothing. A text
of more than ``SHARD_WORDS`` words is counted in parts that overlap, so no phrase is lost. Repeated rows count
each. An empty table, and a language without candidates, give no rows. Scores are exact for counts below 10^15. Ties are
broken by the phrase's UTF-8 bytes; other columns than lang and text aren't looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DEPTH = 3
#: Words of the texts of one trie; three of their numbers fit into 64 bits.
SHARD_WORDS = 2_000_000
#: Bits of the filter of frequent pairs, a power of 2: 16 MB on the driver and in each worker.
FILTER_BITS = 1 << 27
LEAST, TOP, SHARE = 10, 2000, 50
UNKNOWN = "und"

BREAKS = ".,;:!?\n\x0b\x0c\r"
_MARK = b"."
_TABLE = bytes.maketrans(BREAKS.encode() + b"\t", _MARK * len(BREAKS) + b" ")
_NODE = pa.schema([("lang", pa.string()), ("path", pa.string()), ("n", pa.int64())])
_BIT = pa.schema([("at", pa.int64()), ("bits", pa.int64())])


def tokens(text: str) -> list[bytes]:
    """The words of a text, with a mark after each piece."""
    return text.encode().lower().translate(_TABLE).replace(_MARK, b" . ").split() + [_MARK]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    start = lang.encode() + b" "
    return np.fromiter((xxhash.xxh64_intdigest(start + w) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Filter:
    """A bitmap of pairs' hashes: those that were put in are in it, others rarely."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def place(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = hashes >> np.uint64(64 - size.bit_length() + 1)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at, bit = self.place(hashes, len(self.bits) * 64)
        return (self.bits[at] & bit) != 0

    @classmethod
    def of(cls, pairs: DataFrame, size: int) -> Broadcast:
        """The filter of ``pairs`` (lang, path), on all executors; tasks and the driver hold ``size`` bits of it at most."""

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(lang.encode() + b" ", *path.encode().split(b" ")) for lang, path in zip(batch.column("lang").to_pylist(), batch.column("path").to_pylist())]
                first, second = (np.fromiter((xxhash.xxh64_intdigest(r[0] + r[k]) for r in rows), np.uint64, len(rows)) for k in (1, 2))
                at, bit = cls.place(pair_hashes(first, second), size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], schema=_BIT)

        found = pairs.select("lang", "path").mapInArrow(put, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return pairs.sparkSession.sparkContext.broadcast(bits)


def trie(lang: str, words: list[bytes], starts: int, frequent: Filter | None) -> pa.RecordBatch:
    """The nodes of the phrases that begin at one of the first ``starts`` words, in order: up to two words, or those of three whose pairs are ``frequent``."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    number[_MARK]
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    names = sorted(set(number) - {_MARK})
    rank = np.zeros(len(number), np.int64)
    rank[[number[w] for w in names]] = np.arange(1, len(names) + 1)
    starts, padded, base = min(starts, len(words)), np.r_[rank[at], 0, 0], len(names) + 1
    first, second, third = padded[:-2], padded[1:-1], padded[2:]
    follows = (first > 0) & (second > 0)
    word = pa.array(names, pa.binary()).cast(pa.string())
    take = lambda ranks: word.take(pa.array(ranks - 1))
    if frequent is None:
        single = np.bincount(first[:starts], minlength=base)[1:]
        used = np.flatnonzero(single)
        keys, n = np.unique((first * base + second)[:starts][follows[:starts]], return_counts=True)
        path = pa.concat_arrays([pa.array([""]), word.take(pa.array(used)), pc.binary_join_element_wise(take(keys // base), take(keys % base), " ")])
        n = np.concatenate([[single.sum()], single[used], n])
    else:
        pairs, of = np.unique(first * base + second, return_inverse=True)
        hashes = np.r_[np.uint64(0), word_hashes(lang, names)]
        both = follows & frequent.has(pair_hashes(hashes[pairs // base], hashes[pairs % base]))[of]
        whole = both & np.r_[both[1:], False]
        keys, n = np.unique(((first * base + second) * base + third)[:starts][whole[:starts]], return_counts=True)
        path = pc.binary_join_element_wise(take(keys // base // base), take(keys // base % base), take(keys % base), " ")
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(n)), path, pa.array(n.astype(np.int64))], schema=_NODE)


def tries(batches: Iterator[pa.RecordBatch], most: int, frequent: Filter | None) -> Iterator[pa.RecordBatch]:
    """The tries of the texts of one task, each of about ``most`` words."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words = tokens(text.as_py())
            if len(words) > most:
                for k in range(0, len(words), most):
                    yield trie(lang, words[k : k + most + DEPTH - 1], most, frequent)
                continue
            held[lang] += words
            size += len(words)
            if size > most:
                yield from (trie(k, w, len(w), frequent) for k, w in held.items())
                held.clear()
                size = 0
    yield from (trie(k, w, len(w), frequent) for k, w in held.items())


def merged(docs: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, w3, n) of all nodes of at least ``least`` occurrences, and of each language's root."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    most = SHARD_WORDS

    def counted(frequent: Broadcast | None) -> DataFrame:
        count_ = lambda batches: tries(batches, most, None if frequent is None else Filter(frequent.value))
        shards = common.cut(texts.mapInArrow(count_, "lang string, path string, n long"))
        whole = shards.repartitionByRange("lang", "path").groupBy("lang", "path").agg(F.sum("n").alias("n"))
        out = common.cut(whole.filter((F.col("n") >= least) | (F.col("path") == "")))
        common.drop(shards)
        return out

    short = counted(None)
    frequent = Filter.of(short.filter(F.contains("path", F.lit(" "))), FILTER_BITS)
    long = counted(frequent)
    frequent.unpersist()
    word = F.when(F.col("path") != "", F.split("path", " "))
    named = (F.get(word, F.lit(k)).alias(f"w{k + 1}") for k in range(DEPTH))
    return short.unionByName(long).select("lang", *named, "n")


def depth() -> Column:
    return F.when(F.col("w1").isNull(), 0).when(F.col("w2").isNull(), 1).when(F.col("w3").isNull(), 2).otherwise(3)


def walked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the counts of their ancestors of one and two words, l1 and l2."""
    path = ["lang", "w1", "w2", "w3"]
    ranges = common.cut(nodes.repartitionByRange(*path).withColumn("range", F.spark_partition_id()))
    # the ancestors of each range's first node may lie in ranges before it: at most two rows for each range
    first = ranges.groupBy("range").agg(F.min(F.struct(*path)).alias("at")).select("range", "at.*")
    above = first.select("range", F.explode(F.array(F.struct("lang", "w1", F.lit(None).cast("string").alias("w2")), F.struct("lang", "w1", "w2"))).alias("p")).select("range", "p.*").distinct()
    inner = nodes.filter("w3 IS NULL AND w1 IS NOT NULL")
    same = (above["lang"] == inner["lang"]) & (above["w1"] == inner["w1"]) & above["w2"].eqNullSafe(inner["w2"])
    of = inner.join(F.broadcast(above), same).groupBy("range").agg(F.max(F.when(inner["w2"].isNull(), inner["n"])).alias("up1"), F.max(F.when(inner["w2"].isNotNull(), inner["n"])).alias("up2"))
    along = Window.partitionBy("range").orderBy(*path).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(depth() == k, F.col("n")), ignorenulls=True).over(along)
    out = ranges.select("*", last(1).alias("in1"), last(2).alias("in2")).join(F.broadcast(of), "range", "left")
    out = common.cut(out.select(*path, "n", F.coalesce("in1", "up1").alias("l1"), F.coalesce("in2", "up2").alias("l2")))
    common.drop(ranges)
    return out


def linked(rows: DataFrame, to: DataFrame, suffix: list[str], words: list[str], counts: list[str]) -> DataFrame:
    """``rows`` with the ``counts`` of the node of ``to`` whose ``words`` are the row's ``suffix``."""
    key = lambda columns: F.concat_ws(" ", "lang", *columns).alias("link")
    rows = rows.select("*", key(suffix))
    sizes = rows.groupBy("link").agg(F.count(F.lit(1)).alias("links"))
    groups = sizes.join(to.select(key(words), *counts), "link").select("link", "links", *counts)
    return common.join_groups(rows, groups, "link", "links", rows.count()).drop("link", "links")


def score(a: str, left: str, right: str) -> Column:
    whole = lambda name: F.col(name).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase that is part of a longer candidate is dropped if that has at least ``share`` hundredths of its occurrences.
    """
    nodes = merged(docs, least)
    trie_ = walked(nodes)
    singles, pairs, triples = (trie_.filter(depth() == k) for k in (1, 2, 3))
    pairs = common.cut(linked(pairs, singles.select("lang", "w1", F.col("n").alias("r1")), ["w2"], ["w1"], ["r1"]))
    ends = pairs.select("lang", "w1", "w2", F.col("n").alias("r2"), "r1")
    triples = common.cut(linked(triples, ends, ["w2", "w3"], ["w1", "w2"], ["r2", "r1"]))
    inside = triples.select("lang", "n", F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = inside.select("lang", "p.*", "n").groupBy("lang", "w1", "w2").agg(F.max("n").alias("longest"))
    alone = pairs.join(longer, ["lang", "w1", "w2"], "left").filter(F.coalesce(F.col("longest") * 100 < F.col("n") * share, F.lit(True)))
    cut_at = lambda k, left, right: F.struct(score("n", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    both = [
        alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), cut_at(1, "l1", "r1").alias("cut")),
        triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.least(cut_at(1, "l1", "r2"), cut_at(2, "l2", "r1")).alias("cut")),
    ]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    found = both[0].unionByName(both[1]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)  # each task keeps its own first rows before they meet
    roots = nodes.filter("w1 IS NULL").select("lang", "n")
    return best.join(roots, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lines AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM lines, (VALUES (1), (2), (3)) AS sizes(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}
), cuts AS (
  SELECT c.*, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM candidates c, (VALUES (1), (2)) AS places(k) WHERE k < size
), scored AS (
  SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.x = l.phrase JOIN f r ON c.lang = r.lang AND c.y = r.phrase
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longest FROM candidates, (VALUES (1), (2)) AS places(i) WHERE size = 3 GROUP BY ALL
), kept AS (
  SELECT w.* FROM worst w LEFT JOIN parts p ON w.lang = p.lang AND w.phrase = p.phrase
  WHERE w.size = 3 OR p.longest IS NULL OR 100 * p.longest < {SHARE} * w.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
