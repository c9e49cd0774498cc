"""Operator 1, exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Pass one counts how many rows set each bit of a Bloom filter and keeps the bits
that were set at least twice. Pass two tests every row: a row with a bit that
only one row set is certainly the only one of its text and passes straight
through; only the others ("candidates") shuffle on their hash, where groups are
formed exactly.

Defined results: null texts count as empty, so all of them are one group; of
equal texts the largest doc_id stays, a null doc_id being smaller than any
other; of rows that are equal in text and in doc_id, ``deduplicate`` keeps one
and ``report`` marks each. A very long text is one hash like any other. An empty table
gives an empty result. Extra columns are carried along by ``deduplicate``, whatever their
names: helper columns take names that the table doesn't have.

What is shuffled: two positions of 8 bytes for each row in pass one, the hashes of candidates in
pass two. (Bitmaps for each task and bucket in place of positions would be 4 KB for the few
bits that a task sets in a bucket, far more than the positions once there are many buckets.)
The plan is the same at every size: the filter is broadcast in slices of at most ``SLICE_BYTES``, and every row is
tested where it lies by one slice after the other, so no row is shuffled that isn't a candidate. Slices grow in number
with the rows, by one for 134 million rows and seed; executors hold all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Filter bits for each row, rounded up to a power of two.
BITS_PER_ROW = 16
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
#: Bytes of the bitmaps of one broadcast.
SLICE_BYTES = 256 << 20
SEEDS = (11, 23)


def normalised_sha256(text: Column) -> Column:
    return F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _bits(rows: int) -> int:
    return max(BITMAP_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length())


def _position(sha: Column, seed: int, bits: int) -> Column:
    """A bit's number from 1, as the bitmap functions count."""
    return F.xxhash64(sha, F.lit(seed)).bitwiseAND(F.lit(bits - 1)) + 1


def repeated_bits(hashes: DataFrame, sha: str, bits: int, least: int = 2) -> DataFrame:
    """Bitmaps (filter, bucket, bitmap) of the bits that two (or ``least``) or more rows set."""
    points = hashes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("filter"), _position(F.col(sha), seed, bits).alias("position")) for i, seed in enumerate(SEEDS)))).alias("p"))
    twice = points.groupBy("p.filter", "p.position").count().filter(F.col("count") >= least)
    return twice.groupBy("filter", F.bitmap_bucket_number("position").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap"))


def candidates(rows: DataFrame, sha: str, bitmaps: DataFrame, bits: int, flag: str = "candidate") -> DataFrame:
    """``rows`` with a boolean column ``flag``: whether all bits of its hash were set twice. No row moves."""
    names = common.fresh(rows, flag, "bucket", "bitmap")
    test, bucket, bitmap = names[flag], names["bucket"], names["bitmap"]
    columns, marked = rows.columns, rows.withColumn(test, F.lit(0))
    each = max(1, SLICE_BYTES // (BITMAP_BITS // 8))  # buckets of a slice
    for i, seed in enumerate(SEEDS):
        position = _position(F.col(sha), seed, bits)
        bit, own = F.bitmap_bit_position(position), F.bitmap_bucket_number(position)
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        for first in range(1, bits // BITMAP_BITS + 1, each):
            part = bitmaps.filter((F.col("filter") == i) & F.col("bucket").between(first, first + each - 1))
            side = F.broadcast(part.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
            marked = marked.join(side, own == F.col(bucket), "left").select(*columns, (F.col(test) + F.coalesce(F.getbit(byte, (bit % 8).cast("int")).cast("int"), F.lit(0))).alias(test))
    return marked.select(*columns, (F.col(test) == len(SEEDS)).alias(flag))


class Plan:
    """What both outputs share: the rows' hashes, the filter, and the groups of the candidates."""

    def __init__(self, docs: DataFrame):
        self.hashes = common.cut(docs.select("doc_id", normalised_sha256(F.col("text")).alias("text_sha256")))
        self.total = self.hashes.count()
        self.bits = _bits(self.total)
        self.bitmaps = common.cut(repeated_bits(self.hashes, "text_sha256", self.bits))
        self.marked = self.mark(self.hashes, "text_sha256")
        self.groups = self.marked.filter("candidate").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    def mark(self, rows: DataFrame, sha: str, flag: str = "candidate") -> DataFrame:
        return candidates(rows, sha, self.bitmaps, self.bits, flag)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    plan = Plan(docs)
    single = plan.marked.filter(~F.col("candidate")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    several = common.join_groups(plan.marked.filter("candidate").drop("candidate"), common.cut(plan.groups), "text_sha256", "group_size", plan.total)
    both = single.unionByName(several)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; rows of unrepeated texts aren't shuffled."""
    plan = Plan(docs)
    n = common.fresh(docs, "sha", "keep", "key", "flag")
    marked = plan.mark(docs.withColumn(n["sha"], normalised_sha256(F.col("text"))), n["sha"], n["flag"])
    stay = plan.groups.select(F.col("text_sha256").alias(n["key"]), F.col("keep_id").alias(n["keep"]))
    # the join is on the id too: each group keeps few rows, so its key isn't hot
    kept = marked.filter(F.col(n["flag"])).join(stay, (F.col(n["sha"]) == F.col(n["key"])) & F.col("doc_id").eqNullSafe(F.col(n["keep"])), "left_semi").dropDuplicates([n["sha"]])
    return marked.filter(~F.col(n["flag"])).select(docs.columns).union(kept.select(docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.documents(spark, sf_dir))


OP1_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
