"""Operator 12, near-duplicates by SimHash, whose candidates a pigeonring filter prunes.

A fingerprint has 64 bits: a bit is 1 where more than half of the hashes of the text's word shingles, repeats included,
have it. Equal fingerprints are one node. A fingerprint is a ring of ``SEGMENTS`` segments. If two of them differ in at most
``distance`` bits, then at some segment there starts a chain of consecutive segments whose first l differ, for every l,
in at most l * distance / SEGMENTS bits together. For a distance of 4 these budgets are 0 for chains of up to 3 segments, 1 for
up to 7, 2 for 11 and 3 for 15. Nodes meet in a bucket if they agree in the first three segments from a start. In
a bucket, chains of increasing length prune the pairs before all bits are counted.

A bucket of more than ``BUCKET`` nodes, which is counted before anything is shuffled by it, is not compared: its nodes meet again
in narrower buckets, those of the next longer chain, once for each set of segments that may differ within the
budgets. No pair within ``distance`` is lost by that, so it is a matter of cost alone. In the narrowest buckets 48 of
64 bits are equal, so they have at most 65,536 nodes, whatever the input. Of a bucket's links those are returned that connect its
nodes, fewer than it has nodes, as copies of one text would otherwise make links by the square of their number.

Defined results: null and empty texts and those without words have the fingerprint zero, and link like any
other; a text of fewer words than a shingle is one shingle; very long texts are hashed in parts. Repeated rows
are documents of their own in one component. A component's id is its smallest doc_id; where a null doc_id
is a document like any other, but a component has a null id only if all its ids are null. An empty table gives an
empty result; other columns than doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH, DISTANCE, SEED = 4, 4, 42
SEGMENTS = 16
SEGMENT_BITS = 64 // SEGMENTS
#: Nodes of a bucket that are compared; those of larger ones meet again in narrower buckets.
BUCKET = 2048
#: Hashes of a text whose bits are added up at once.
PART = 8192


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()  # bytes know ASCII alone: A-Z are lowered, and they are split at space and 9 to 13
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[width:] or starts[-1:]
    counts, n = np.zeros(64, np.int64), len(ends)
    for k in range(0, n, PART):
        hashes = [xxhash.xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts[k : k + PART], ends[k : k + PART])]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id and fp, its fingerprint's bits as a long."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = np.array([fingerprint(t, width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": marks})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(sign, "doc_id long, fp long")


def reach(distance: int, budget: int) -> int:
    """Segments of the longest chain that may differ in at most ``budget`` bits."""
    return -(-(budget + 1) * SEGMENTS // distance) - 1


def excused(distance: int, budget: int) -> list[tuple[int, ...]]:
    """The sets of ``budget`` segments of a chain that may differ, within the budgets of all shorter chains."""
    within = lambda m: all(sum(x < reach(distance, b) for x in m) <= b for b in range(budget))
    return [m for m in combinations(range(reach(distance, budget)), budget) if within(m)]


def bits_of(start: int, segments) -> int:
    return sum(((1 << SEGMENT_BITS) - 1) << SEGMENT_BITS * ((start + s) % SEGMENTS) for s in segments)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def buckets(distance: int, budget: int) -> list[tuple[int, int, int, int]]:
    """The kinds of buckets of a budget: number, start, the bits that are equal in it, and the number of the wider kind that leads to it."""
    sets, wider = excused(distance, budget), excused(distance, budget - 1) if budget else [()]
    out = []
    for start in range(SEGMENTS):
        for k, m in enumerate(sets):
            inner = {x for x in m if budget and x < reach(distance, budget - 1)}
            above = next(i for i, w in enumerate(wider) if inner <= set(w))
            out.append((start * len(sets) + k, start, signed(bits_of(start, set(range(reach(distance, budget))) - set(m))), start * len(wider) + above))
    return out


def connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, which names each node's tree by its first node, after the trees of a and b are joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


def compare(fp: np.ndarray, kind: np.ndarray, key: np.ndarray, start: np.ndarray, distance: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the nodes of each bucket (rows of one kind and key, which are adjacent) that connect all that are within ``distance``."""
    n = len(fp)
    chains = [np.array([bits_of(s, range(reach(distance, b))) for s in range(SEGMENTS)], np.uint64) for b in range(budget + 1, distance)]
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
    left = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n])) - np.arange(n)
    label, at, step = np.arange(n), np.flatnonzero(left > 1), 1
    while len(at):
        differ, pair = fp[at] ^ fp[at + step], at
        for b, bits in enumerate(chains, budget + 1):
            near = np.bitwise_count(differ & bits[start[pair]]) <= b
            differ, pair = differ[near], pair[near]
        pair = pair[np.bitwise_count(differ) <= distance]
        if len(pair):
            label = connected(label, pair, pair + step)
        step += 1
        at = at[left[at] > step]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[label[moved]], fp[moved]


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (fp, distinct) within ``distance`` bits of each other."""
    if not 1 <= distance <= SEGMENTS // 2:
        raise ValueError(f"a distance is from 1 to {SEGMENTS // 2}")
    wide = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(start).alias("start"), F.col("fp").bitwiseAND(F.lit(bits)).alias("key")) for kind, start, bits, _ in buckets(distance, 0)))
    rows, found, spent = nodes.select("fp", F.explode(wide).alias("in")).select("fp", "in.*"), None, []
    for budget in range(distance):
        rest = rows
        if budget < distance - 1:
            large = common.cut(rows.groupBy("kind", "key").count().filter(F.col("count") > BUCKET).select(F.col("kind").alias("l_kind"), F.col("key").alias("l_key")))
            spent.append(large)
            same = (F.col("kind") == F.col("l_kind")) & (F.col("key") == F.col("l_key"))
            if more := not large.isEmpty():
                rest = rows.join(large, same, "left_anti")

        def look(batches: Iterator[pd.DataFrame], budget: int = budget) -> Iterator[pd.DataFrame]:
            held = None  # a bucket that may go on in the next batch
            for batch in batches:
                batch = batch if held is None else pd.concat([held, batch])
                end = batch.iloc[-1]
                whole = ~((batch["kind"] == end["kind"]) & (batch["key"] == end["key"]))
                held = batch[~whole]
                yield pd.DataFrame(_links(batch[whole], distance, budget))
            if held is not None:
                yield pd.DataFrame(_links(held, distance, budget))

        sorted_ = rest.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
        some = common.cut(sorted_.mapInPandas(look, "a long, b long").distinct())
        found = some if found is None else found.unionByName(some)
        if budget == distance - 1 or not more:
            break
        # a fixed table of at most SEGMENTS times the sets that are excused
        kinds = nodes.sparkSession.createDataFrame(buckets(distance, budget + 1), "kind int, start int, bits long, wider int")
        deeper = rows.join(large, same, "left_semi").select("fp", F.col("kind").alias("wider")).join(F.broadcast(kinds), "wider")
        rows = common.cut(deeper.select("fp", "kind", "start", F.col("fp").bitwiseAND(F.col("bits")).alias("key")))
        spent.append(rows)
    common.drop(*spent)
    return found


def _links(rows: pd.DataFrame, distance: int, budget: int) -> dict:
    column = lambda name, kind: rows[name].to_numpy(kind)
    if not len(rows):
        return {"a": [], "b": []}
    a, b = compare(column("fp", np.int64).view(np.uint64), column("kind", np.int64), column("key", np.int64), column("start", np.int64), distance, budget)
    return {"a": a.view(np.int64), "b": b.view(np.int64)}


def report(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    marked = common.cut(fingerprints(docs, width))
    nodes = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    near = links(nodes.select("fp"), distance)
    of = components(near).select(F.col("node").alias("n_fp"), "component")
    every = nodes.join(of, F.col("fp") == F.col("n_fp"), "left").select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("component"))
    lowest = every.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = common.cut(every.join(lowest, "component").select("fp", "copies", "component_id"))
    # a fingerprint of many copies isn't joined by a shuffle of its rows
    out = common.join_groups(marked, named, "fp", "copies", marked.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.documents(spark, sf_dir))
