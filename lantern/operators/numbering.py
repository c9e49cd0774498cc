"""Dense numbers and greedy batches of ordered rows, without a group in one task or one row.

``numbered`` deals rows out by ranges of their order; a row's number is its place in its range and group, and the rows that
the group has in ranges before. ``batched`` needs more than sums, as each greedy batch begins where the one before ends: blocks
of ``ROWS`` rows are walked from each of the few rows where a batch may begin in them, which gives a function from the
entry of a block to that of the next. These functions are composed in rounds of doubled steps, so the entries
of all blocks are known after as many rounds as the logarithm of their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.sources.checkpoints import cut, drop

#: Rows of a block of ``batched``.
ROWS = 4096


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, into: str = "number") -> DataFrame:
    """``rows`` with dense numbers from 0, in ``order``, within each group of ``by``; rows of equal order are numbered in any way."""
    by = by or []
    at = F.monotonically_increasing_id()
    dealt = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.shiftrightunsigned(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a group has as many rows here as ranges
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    side = parts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(side, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(into))


def batched(rows: DataFrame, order: list[str], size: str, most: int, most_size: int, by: str | None = None) -> DataFrame:
    """``rows`` with ``number`` (from 0) and ``batch`` (from 1) within each group of ``by``.

    In order, a batch takes rows up to ``most`` of them and ``most_size`` in all; one row may be larger.
    """
    key = "_group"
    items = rows.withColumn(key, F.col(by).cast("string") if by else F.lit("")).withColumn("_set", F.col(key).isNotNull())
    items = cut(numbered(items.withColumn(key, F.coalesce(key, F.lit(""))), order, ["_set", key]))
    width = max(ROWS, most)
    block = F.floor(F.col("number") / width)
    light = items.select("_set", key, "number", F.col(size).cast("long").alias("size"), block.alias("block"))
    # a block also has the first rows of the next one, where its last batch may end
    halo = light.filter((F.col("number") % width < most) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)

    def walk(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("number")
        number, total = of["number"].to_numpy(), np.r_[0, of["size"].to_numpy().cumsum()]
        first, k = number[0], int(of["block"].iloc[0])
        own, exits, starts, ends = int((number // width == k).sum()), [], [], []
        for entry in range(most if k else 1):
            at, here = entry, []
            while at < own:
                here.append(at)
                # the last row whose running sum is still within, one at least
                at = min(at + most, max(at + 1, int(np.searchsorted(total, total[at] + most_size, "right")) - 1), len(number))
            exits.append(max(at - own, 0))
            starts.append([int(first + s) for s in here])
            ends.append([int(first + e) for e in [*here[1:], at][: len(here)]])
        return pd.DataFrame({"_set": [of["_set"].iloc[0]], key: [of[key].iloc[0]], "block": [k], "exits": [exits], "starts": [starts], "ends": [ends]})

    blocks = light.unionByName(halo).groupBy("_set", key, "block").applyInPandas(walk, f"_set boolean, {key} string, block long, exits array<int>, starts array<array<long>>, ends array<array<long>>")
    blocks = cut(blocks)
    through = blocks.select("_set", key, "block", "exits")
    step, last, spent = 1, blocks.agg(F.max("block")).first()[0] or 0, []
    while step <= last:
        earlier = through.select(F.col("_set").alias("e_set"), F.col(key).alias("e_key"), (F.col("block") + step).alias("e_block"), F.col("exits").alias("earlier"))
        same = (F.col("_set") == F.col("e_set")) & (F.col(key) == F.col("e_key")) & (F.col("block") == F.col("e_block"))
        both = through.join(earlier, same, "left")
        through = cut(both.select("_set", key, "block", F.when(F.col("earlier").isNull(), F.col("exits")).otherwise(F.transform("earlier", lambda e: F.get("exits", e))).alias("exits")))
        spent.append(through)
        step *= 2
    entries = through.select("_set", key, (F.col("block") + 1).alias("block"), F.col("exits")[0].alias("entry"))
    entered = blocks.join(entries, ["_set", key, "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    found = entered.select("_set", key, F.explode(F.arrays_zip(F.get("starts", F.col("entry")).alias("start"), F.get("ends", F.col("entry")).alias("end"))).alias("b")).select("_set", key, "b.*")
    placed = numbered(found, ["start"], ["_set", key], "batch").select("_set", key, (F.col("batch") + 1).cast("int").alias("batch"), F.explode(F.sequence("start", F.col("end") - 1)).alias("number"))
    out = cut(items.join(placed, ["_set", key, "number"]).select(*rows.columns, "number", "batch"))
    drop(blocks, items, *spent)
    return out
