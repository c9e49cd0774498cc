"""Connected components of a table of links, by contracting it until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Each round gives every node the first of its neighbours and itself, in an order
    by hashes that changes from round to round, and replaces both ends of all links
    by these labels. So a star of any size becomes one node in a round or two, and a chain
    loses a share of its nodes in each, in whatever order its names are: the rounds are about
    the logarithm of the longest path. Labels and links are written to tables in the
    checkpoint folder after each round, and those of the round before are deleted. A node
    with very many links is aggregated before it is shuffled, and its links are split by Spark's
    skew-join handling.
    """
    edges = links.select("a", "b").filter("a != b").distinct()
    assigned, turn, spent = None, 0, []
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        ranked = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("node"))
        labels = common.cut(both.groupBy("a").agg(F.least(ranked("a"), F.min(ranked("b")))["node"].alias("label")))
        moved = labels.select(F.col("a").alias("m_node"), F.col("label").alias("m_label"))
        if assigned is None:
            after = labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
        else:
            after = common.cut(assigned.join(moved, F.col("component") == F.col("m_node"), "left").select("node", F.coalesce("m_label", "component").alias("component")))
        for end in ("a", "b"):
            edges = edges.join(labels.select(F.col("a").alias(end), F.col("label").alias(f"{end}_label")), end)
        edges = edges.filter("a_label != b_label").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct()
        edges = common.cut(edges)
        common.drop(*spent)
        assigned, turn, spent = after, turn + 1, [edges, labels, after]
        if edges.isEmpty():
            names = assigned.groupBy("component").agg(F.min("node").alias("name"))
            out = common.cut(assigned.join(names, "component").select("node", F.col("name").alias("component")))
            common.drop(*spent)
            return out
