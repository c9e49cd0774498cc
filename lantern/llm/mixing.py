"""Operator 9, mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

The mix is a schedule of ``SLOTS`` slots of equally many words. The golden-ratio
points of the slots fall into the cumulative target shares of the sources, so
every stretch of the schedule is close to the targets. Each source's documents
are shuffled by a hash and laid end to end; the document whose middle word is in a
block of words belongs to it. A source's k-th slot takes its k-th block, going round
again when the blocks run out, three times at most.

A source whose words or target are fewer than ``FEW`` slots' has blocks of its own:
the lesser of the two by ``FEW``. As many of them as make its target are taken, whole
passes first, at even distances over the whole schedule. So every source is within
some hundredths of its target, and within half a document at each end of what it
takes, however many words a slot has. ``OP9_SQL`` states the schedule of all other
sources; it holds for tables that have no such small source.

Shuffling, laying out and ranking go by (source, bucket) with running totals of
the buckets, so a source with most of the rows is spread over many tasks.

Defined results: null texts have no words and are never taken, nor are texts
without words; a null source is a source of its own, the last one; repeated
rows are laid out each; an empty table, or one without words, gives targets of
0. Reruns agree, as only hashes of ids decide the order. A very long text, even of more words
than a slot, is in the block of its middle word alone, so its source may miss its target by half
of it at either end. Null ids are ordered as an empty one; rows of one id tie by their size. Other
columns are carried along in a struct of their own, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Slots of the schedule, whatever the input: the words taken are exact to some slots' words.
SLOTS = 1 << 18
#: A source of fewer slots gets as many blocks of its own.
FEW = 256
#: Most times a document is taken.
REPEATS = 3
WEIGHTS = (1, 2, 3)
GOLDEN = 0.6180339887498949
#: The unit interval in whole numbers, and the cells by which points find their source.
UNIT, CELL = 1 << 40, 1 << 28
#: Rows that one bucket of a source is meant to have.
BUCKET_ROWS = 8192
#: Slots ranked together.
RUN = 4096
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """Per source: s_source, source_size, weight, target, from and to (its part of the unit interval).

    Works on one row for each source. A source is held at ``REPEATS`` times its
    size if its share by weight is more, once all sources with less room for
    their weight are held; the rest share what is left by weight.
    """
    sums = sized.groupBy(F.col(source).alias("s_source")).agg(F.sum(size).alias("source_size"))
    named = Window.orderBy(F.col("s_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(named) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * REPEATS)
    tight = Window.orderBy(F.col("most") / F.col("weight"), F.col("s_source").asc_nulls_last())
    everything = Window.partitionBy()
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    held = weighed.withColumn("held", F.col("most") < level * F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    free = F.sum(F.when(~F.col("held"), F.col("weight"))).over(everything)
    bound = F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(everything), F.lit(0))
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise((F.col("total") - bound) / free * F.col("weight"))
    shared = held.withColumn("target", target).withColumn("part", F.coalesce(F.floor(F.try_divide("target", "total") * UNIT), F.lit(0)))
    upto = F.sum("part").over(named.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead(F.lit(1)).over(named).isNull()
    return shared.select("s_source", "source_size", "weight", "target", (upto - F.col("part")).alias("from"), F.when(last, F.lit(UNIT)).otherwise(upto).alias("to"))


def schedule(spark: SparkSession, shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per slot: slot, s_source, blocks (how many its source has) and rank, from 0 among the source's slots."""
    points = spark.range(slots).select(F.col("id").alias("slot"), F.floor((F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)) * UNIT).alias("point")).withColumn("cell", F.floor(F.col("point") / CELL))
    spans = shares.filter(F.col("from") < F.col("to")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / CELL), F.floor((F.col("to") - 1) / CELL))))
    dealt = points.join(spans, "cell").filter((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to"))).select("slot", "s_source", "blocks", F.floor(F.col("slot") / RUN).alias("run"))
    runs = dealt.groupBy(F.col("s_source").alias("r_source"), F.col("run").alias("r_run")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("r_source").orderBy("r_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("s_source", "run").orderBy("slot")) - 1
    both = dealt.withColumn("own", own).join(runs.select("r_source", "r_run", before.alias("before")), F.col("s_source").eqNullSafe(F.col("r_source")) & (F.col("run") == F.col("r_run")))
    return both.select("slot", "s_source", "blocks", (F.col("own") + F.col("before")).alias("rank"))


def own_schedule(shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The slots of small sources, as ``schedule`` has them: as many as make the target, at even distances from a start by the source's hash."""
    n = F.round(F.try_divide(F.col("target") * FEW, F.least("source_size", "target"))).cast("long")
    start = F.pmod(F.xxhash64("s_source"), F.lit(1 << 20)) / float(1 << 20)
    each = shares.withColumn("n", n).filter("n > 0").withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select(F.floor((F.col("rank") + start) * slots / F.col("n")).alias("slot"), "s_source", "blocks", "rank")


def laid_out(sized: DataFrame, shares: DataFrame, rows: int) -> DataFrame:
    """``sized`` (m_source, m_size, m_hash) with m_block: the block of its source's words that has a document's middle.

    ``shares`` has for each source how many blocks (``of``) so many words (``per``) are.
    """
    buckets = max(64, rows // BUCKET_ROWS)
    dealt = sized.withColumn("m_bucket", F.conv(F.substring("m_hash", 1, 8), 16, 10).cast("long") % buckets)
    sums = dealt.groupBy(F.col("m_source").alias("b_source"), F.col("m_bucket").alias("b_bucket")).agg(F.sum("m_size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scales = shares.select("s_source", F.col("of").alias("b_of"), F.col("per").alias("b_per"))
    shift = sums.select("b_source", "b_bucket", before.alias("b_before")).join(scales, F.col("b_source").eqNullSafe(F.col("s_source"))).drop("s_source")
    order = Window.partitionBy("m_source", "m_bucket").orderBy("m_hash", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("m_own", F.coalesce(F.sum("m_size").over(order), F.lit(0)))
    both = own.join(shift, F.col("m_source").eqNullSafe(F.col("b_source")) & (F.col("m_bucket") == F.col("b_bucket")))
    middle = F.col("m_own") + F.col("b_before") + F.shiftright("m_size", 1)
    block = F.floor(F.try_divide(middle.cast("double") * F.col("b_of"), F.col("b_per")))
    # documents without words are in no block: numbers of their own below zero, so that they don't meet on one key
    apart = -1 - F.pmod(F.xxhash64("m_hash"), F.lit(1 << 20))
    return both.withColumn("m_block", F.when(F.col("m_size") > 0, block).otherwise(apart)).drop("b_source", "b_bucket", "b_before", "b_of", "b_per", "m_own", "m_bucket")


def mix(docs: DataFrame, keep: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them if not given) inside ``row``, with m_size, m_source_size, m_target and m_slots.

    m_slots is the array of the slots that take the document, one for each copy.
    """
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    order = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = common.cut(docs.select(F.struct(*keep).alias("row"), F.col("source").alias("m_source"), words(F.col("text")).alias("m_size"), order.alias("m_hash")))
    shares = common.cut(targets(sized, "m_source", "m_size"))
    count = sized.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("m_size"), F.lit(0)).alias("total")).first()
    total, base = float(max(count["total"], 1)), F.least("source_size", "target")
    small = base * slots < FEW * total
    scaled = shares.withColumns({"small": small, "of": F.when(small, float(FEW)).otherwise(float(slots)), "per": F.when(small, base).otherwise(total)})
    scaled = scaled.withColumn("blocks", F.coalesce(F.ceil(F.try_divide(F.col("source_size").cast("double") * F.col("of"), F.col("per"))), F.lit(0)))
    planned = schedule(spark, scaled.filter("NOT small"), slots).unionByName(own_schedule(scaled.filter("small"), slots))
    taken = planned.filter((F.col("blocks") > 0) & (F.floor(F.col("rank") / F.col("blocks")) < REPEATS))
    takes = taken.groupBy(F.col("s_source").alias("t_source"), (F.col("rank") % F.col("blocks")).alias("t_block")).agg(F.sort_array(F.collect_list("slot")).alias("m_slots"))
    placed = laid_out(sized, scaled, count["rows"])
    mixed = placed.join(takes, F.col("m_source").eqNullSafe(F.col("t_source")) & (F.col("m_block") == F.col("t_block")), "left")
    whole = mixed.join(shares.select("s_source", F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target")), F.col("m_source").eqNullSafe(F.col("s_source")))
    return whole.select("row", "m_size", "m_source_size", "m_target", F.coalesce("m_slots", F.array().cast("array<bigint>")).alias("m_slots"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Only ids, sizes and hashes go through the schedule; whole rows are shuffled once, to be joined
    with the slots that take them. Rows of equal id, source and text are taken as often as all of
    them together, each time with the other columns of one of them.
    """
    n = common.fresh(docs, "key", "id", "taken", "slot")
    key = F.xxhash64("doc_id", "source", "text")
    mixed = common.cut(mix(docs.select("doc_id", "source", "text", key.alias("key")), ["doc_id", "key"]).select("row.doc_id", "row.key", "m_slots"))
    named = mixed.groupBy(F.col("doc_id").alias(n["id"]), F.col("key").alias(n["taken"])).agg(F.flatten(F.collect_list("m_slots")).alias(n["slot"]), F.count(F.lit(1)).alias("copies"))
    named = common.cut(named.filter(F.size(n["slot"]) > 0))
    both = lambda side: (F.col(n["key"]) == side[n["taken"]]) & F.col("doc_id").eqNullSafe(side[n["id"]])
    keyed, single, repeated = docs.withColumn(n["key"], key), named.filter("copies = 1").drop("copies"), named.filter("copies > 1").drop("copies")
    found = keyed.join(single, both(single))
    if not repeated.isEmpty():
        found = found.unionByName(keyed.join(repeated, both(repeated)).dropDuplicates(["doc_id", n["key"]]))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(n["slot"]).alias(n["slot"])).drop(n["slot"])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.documents(spark, sf_dir), ["doc_id"])
    return mixed.select("row.doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.size("m_slots")).alias("taken"))


OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), n AS (
  SELECT CAST(sum(size) AS BIGINT) AS total, greatest(64, count(*) // {BUCKET_ROWS}) AS buckets FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {REPEATS} * CAST(sum(size) AS BIGINT) AS most,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS BIGINT) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT sources.*, total,
         (total - coalesce(CAST(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM sources, n
), held AS (
  SELECT *, most < level * weight AS is_held FROM levels
), shares AS (
  SELECT source, source_size, total, CASE WHEN is_held THEN CAST(most AS DOUBLE) ELSE
         (total - coalesce(CAST(sum(most) FILTER (is_held) OVER () AS BIGINT), 0)) / CAST(sum(weight) FILTER (NOT is_held) OVER () AS DOUBLE) * weight END AS target
  FROM held
), parts AS (
  SELECT *, CAST(floor(target / total * {UNIT}) AS BIGINT) AS part FROM shares
), bounds AS (
  SELECT source, source_size, target, total, CAST(ceil(CAST(source_size AS DOUBLE) * {SLOTS} / total) AS BIGINT) AS blocks,
         CAST(sum(part) OVER w AS BIGINT) - part AS lower_end,
         CASE WHEN lead(1) OVER w IS NULL THEN {UNIT} ELSE CAST(sum(part) OVER w AS BIGINT) END AS upper_end
  FROM parts WINDOW w AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), slots AS (
  SELECT i, CAST(floor((i * CAST({GOLDEN} AS DOUBLE) - floor(i * CAST({GOLDEN} AS DOUBLE))) * {UNIT}) AS BIGINT) AS point FROM range({SLOTS}) t(i)
), ranks AS (
  SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS r FROM slots JOIN bounds ON point >= lower_end AND point < upper_end
), takes AS (
  SELECT source, r % blocks AS block, count(*) AS copies FROM ranks WHERE blocks > 0 AND r // blocks < {REPEATS} GROUP BY ALL
), laid AS (
  SELECT sized.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % buckets, h, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized, n
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * coalesce(copies, 0) ELSE 0 END AS BIGINT) AS taken
FROM laid JOIN bounds ON laid.source IS NOT DISTINCT FROM bounds.source
LEFT JOIN takes ON laid.source IS NOT DISTINCT FROM takes.source AND CAST(floor(CAST(start + size // 2 AS DOUBLE) * {SLOTS} / total) AS BIGINT) = block
"""
