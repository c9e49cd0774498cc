"""Operator 10, near-duplicate detection by min-max hashing.

A document's set holds the 64-bit hashes of its word shingles. Under each of
``PERMUTATIONS`` hash permutations both the minimum and the maximum are kept,
so half the hash evaluations give a signature of the usual length; both are
unbiased estimators. ``BANDS`` bands of ``ROWS`` values each make two sets of
Jaccard similarity 0.8 meet in some band but for 1 in 8 million pairs.

Documents of equal sets are one node. Every node of a band's bucket is compared
with the bucket's leader, its smallest node, on their full sets; this gives the
first links, and for each (leader, node) the shingles that only one of the two has,
the node's ``delta``. Two nodes of one leader differ in just those shingles that are
in one of their two deltas, so deltas, which are short, stand for the sets from then
on. Of the nodes that share a leader, those outside the leader's largest component are
joined with all others, in blocks of at most ``BLOCK`` nodes. The join's own condition
is the exact similarity, after two bounds that never drop a link, so it makes links
alone: connected nodes are not compared, and unlike ones give no row. Two texts that
meet in some band are therefore linked for certain if they are similar enough; the
banding, which misses 1 in 8 million pairs at 0.8, is the only thing left to chance.

Defined results: null texts and texts without words have an empty set, link
with nothing and stay; a text with fewer words than a shingle is one shingle; a very
long text is one set like any other, hashed in parts. Repeated rows are documents of
their own in the same component. A null doc_id is larger than any other, so such a row
is kept only where its component has no doc_id; rows that share a doc_id are told apart
by their texts. ``deduplicate`` keeps one row of each component, the one of the smallest
doc_id (of several, one by a hash of the text), and all columns of ``docs``, whatever their
names; other columns than doc_id and text aren't looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

PERMUTATIONS, BANDS, ROWS = 100, 40, 5
#: Similarity in hundredths.
THRESHOLD = 80
#: Nodes of one leader that a task compares another node with.
BLOCK = 2048
#: Nodes of one leader that a task joins with the leader's set.
SALTED = 256
#: Words of the bitmap that bounds how much two deltas differ.
BITMAP = 8
SEED = 20


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda *n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(PERMUTATIONS, 1), draw(PERMUTATIONS, 1), draw(BANDS, ROWS)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; the text is lower-cased already."""
    words = text.encode().split()  # bytes are split at space and 9 to 13, as wanted
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for i in range(min(width, len(words))):
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(out)


def signature(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima and maxima of the set under each permutation; long sets by parts."""
    low, high = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    for k in range(0, len(members), 8192):
        under = members[k : k + 8192] * a + b
        low, high = np.minimum(low, under.min(1)), np.maximum(high, under.max(1))
    return np.concatenate([low, np.roll(high, len(a) // 4)])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, key (a hash of doc_id and text), n_shingles, node (a digest of its set, null if empty) and bands (its bucket in each band)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, mixers = _constants()
        for batch in batches:
            n, nodes, bands = [], [], []
            for text in batch["text"]:
                members = shingle_set(text, width)
                n.append(len(members))
                nodes.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
                # the maxima are turned by a quarter, so that no band has both ends of one permutation
                values = signature(members, a, b).reshape(ROWS, BANDS).T if len(members) else None
                bands.append(np.empty(0, np.int64) if values is None else scramble((scramble(values) * mixers).sum(1, dtype=np.uint64)).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n_shingles": n, "node": nodes, "bands": bands})

    return _texts(docs).mapInPandas(sign, "doc_id long, key long, n_shingles long, node binary, bands array<long>")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), common.ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """Per row of ``texts``: s_node and members."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({"s_node": [xxhash.xxh3_128_digest(m.tobytes()) for m in members], "members": [m.view(np.int64) for m in members]})

    return texts.select("text").mapInPandas(build, "s_node binary, members array<long>")


def _similar(differing: Column, sizes: Column, threshold: int) -> Column:
    """Whether sets of so many elements together, of which so many are in one set alone, are similar enough."""
    return differing * (100 + threshold) <= sizes * (100 - threshold)


def _bitmap(delta: str) -> Column:
    """A bit for each element. Bits that differ between two of these come from different elements."""

    def word(k: int) -> Column:
        own = F.filter(delta, lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(BITMAP - 1)) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))

    return F.array(*map(word, range(BITMAP)))


class Duplicates:
    """The nodes of ``docs`` and the components of their links."""

    def __init__(self, docs: DataFrame, width: int = 5, threshold: int = THRESHOLD):
        self.docs, self.width, self.threshold = docs, width, threshold
        self.signed = common.cut(signatures(docs, width))
        filled = self.signed.filter("node IS NOT NULL")
        nodes = filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        self.nodes = common.cut(nodes.withColumn("id", F.monotonically_increasing_id()))
        met = self.met()
        links = met.filter("linked").select(F.col("leader").alias("a"), F.col("id").alias("b"))
        more = common.cut(self.more(met, components(links)))
        self.of_node = components(links if more.isEmpty() else links.unionByName(more))
        common.drop(more, met)

    def met(self) -> DataFrame:
        """(leader, id, n, linked, delta) for every node and each smallest node of one of its buckets."""
        rows = common.cut(self.nodes.select(F.explode("bands").alias("bucket"), "id"))
        buckets = rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        # a bucket of very many nodes isn't joined by a shuffle of its nodes
        star = common.join_groups(rows, common.cut(buckets), "bucket", "size", rows.count())
        star = common.cut(star.filter("id != leader").select("leader", "id").distinct())
        wanted = star.select(F.explode(F.array("leader", "id")).alias("id")).distinct()
        named = common.cut(self.nodes.join(wanted, "id").select("id", "n", "node", "key"))
        keys = named.select(F.col("key").alias("wanted_key"))
        texts = _texts(self.docs).join(keys, F.col("key") == F.col("wanted_key"), "left_semi")
        sets = sets_of(texts, self.width).dropDuplicates(["s_node"])
        sets = common.cut(named.join(sets, F.col("node") == F.col("s_node")).select("id", "n", "members"))
        # the nodes of a leader are dealt to tasks by at most SALTED, each of which has the leader's set once
        salts = common.cut(star.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).withColumn("salts", F.ceil(F.col("size") / SALTED)))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
        heads = sets.join(salts.select("leader", copies), F.col("id") == F.col("leader")).select("leader", "salt", F.col("n").alias("leader_n"), F.col("members").alias("leader_members"))
        dealt = common.join_groups(star, salts, "leader", "size", star.count()).select("leader", "id", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
        both = dealt.join(sets, "id").join(heads, ["leader", "salt"])
        delta = F.concat(F.array_except("members", "leader_members"), F.array_except("leader_members", "members"))
        found = both.select("leader", "id", "n", "leader_n", delta.alias("delta"))
        out = common.cut(found.select("leader", "id", "n", _similar(F.size("delta"), F.col("n") + F.col("leader_n"), self.threshold).alias("linked"), "delta"))
        common.drop(rows, star, named, sets, salts)
        return out

    def more(self, met: DataFrame, known: DataFrame) -> DataFrame:
        """The links (a, b) between nodes that share a leader and aren't known to be connected."""
        labels = known.select(F.col("node").alias("id"), "component")
        held = common.cut(met.select("leader", "id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
        parts = held.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("size"))
        groups = parts.groupBy("leader").agg(F.sum("size").alias("size"), F.max(F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        groups = common.cut(groups.select("leader", "size", F.col("most.component").alias("most"), F.ceil(F.col("size") / BLOCK).alias("blocks")))
        # a leader of very many nodes isn't joined by a shuffle of its nodes
        placed = common.join_groups(held, groups, "leader", "size", held.count())
        mixed = placed.join(met.select("leader", "id", "delta"), ["leader", "id"])
        member = common.cut(mixed.select("leader", "most", "blocks", F.struct("id", "n", "component", "delta", _bitmap("delta").alias("bits")).alias("member")))
        one = member.filter("member.component != most").select("leader", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("member").alias("a"))
        other = member.select("leader", F.pmod(F.xxhash64("member.id"), F.col("blocks")).alias("block"), F.col("member").alias("b"))
        apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("most")) | (F.col("a.id") < F.col("b.id")))
        both = one.join(other, ["leader", "block"]).filter(apart & self.close())
        return both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()

    def close(self) -> Column:
        """Whether members a and b of one leader are similar enough: by two bounds on how many shingles differ, then exactly."""
        sizes, lengths = F.col("a.n") + F.col("b.n"), F.size("a.delta") + F.size("b.delta")
        bits = reduce(lambda x, y: x + y, (F.bit_count(F.get("a.bits", F.lit(k)).bitwiseXOR(F.get("b.bits", F.lit(k)))) for k in range(BITMAP)))
        exact = lengths - 2 * F.size(F.array_intersect("a.delta", "b.delta"))
        return _similar(F.abs(F.size("a.delta") - F.size("b.delta")), sizes, self.threshold) & _similar(bits, sizes, self.threshold) & _similar(exact, sizes, self.threshold)

    def report(self) -> DataFrame:
        """Per row of the input: doc_id, n_shingles, component_id, kept."""
        return self.marked().drop("key", "component")

    def marked(self) -> DataFrame:
        """``report`` with each row's key and its component (null if it has none but itself)."""
        of = self.of_node.select(F.col("node").alias("c_id"), "component")
        linked = self.nodes.select("id", "first_id").join(of, F.col("id") == F.col("c_id")).select("id", "first_id", "component")
        lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = linked.join(lowest, "component").select(F.col("id").alias("l_id"), "component", "component_id")
        every = self.nodes.select("id", "node", "copies", "first_id").join(named, F.col("id") == F.col("l_id"), "left")
        nodes = common.cut(every.select("node", "copies", F.coalesce("component", "id").alias("component"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")))
        # a node of many copies isn't joined by a shuffle of its rows
        filled = self.signed.filter("node IS NOT NULL").select("doc_id", "key", "n_shingles", "node")
        found = common.join_groups(filled, nodes, "node", "copies", self.signed.count()).select("doc_id", "key", "n_shingles", "component", "component_id")
        alone = self.signed.filter("node IS NULL").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
        return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, the one of the smallest doc_id."""
    n = common.fresh(docs, "key", "row_id", "row_key")
    rows = common.cut(Duplicates(docs, width, threshold).marked().select("doc_id", "key", "component", "kept").filter("component IS NOT NULL"))
    # of a component's rows with the smallest doc_id, those of the least key stay: one, unless it is repeated whole
    stay = rows.filter("kept").groupBy("component").agg(F.min("key").alias("least"))
    named = rows.join(stay, "component").select(F.col("doc_id").alias(n["row_id"]), F.col("key").alias(n["row_key"]), (F.col("kept") & (F.col("key") == F.col("least"))).alias("stays"))
    counted = common.cut(named.groupBy(n["row_id"], n["row_key"], "stays").agg(F.count(F.lit(1)).alias("copies")))
    keyed = docs.withColumn(n["key"], _key())
    same = lambda side: (keyed[n["key"]] == side[n["row_key"]]) & keyed["doc_id"].cast("long").eqNullSafe(side[n["row_id"]])
    gone, twice = counted.filter("NOT stays"), counted.filter("stays AND copies > 1")
    if twice.isEmpty():
        return keyed.join(gone, same(gone), "left_anti").select(docs.columns)
    once = keyed.join(rest := counted.filter("NOT stays OR copies > 1"), same(rest), "left_anti")
    return once.unionByName(keyed.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", n["key"]])).select(docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Duplicates(common.documents(spark, sf_dir), width=2).report()
