"""Operator 7, WARC archives: writing pages, and reading records by boundary-chain verification.

Writing. Pages of equal payload are one group: the smallest page_id is a
``response`` record with the payload, the others are ``revisit`` records that
refer to it and keep the HTTP header alone. A Bloom filter finds the digests
that may be repeated; all other pages are written where they were read.

Reading. Spark's reader splits the files at the magic ``WARC/1.1`` line. Every
piece is a candidate record whose header gives the offset of its successor.
Payloads may hold the magic too, so pointer jumping from each file's start keeps
the reachable candidates alone: after k rounds, all within 2^k records. A record
whose payload held the magic is put together again from its pieces.

Defined results: null html counts as empty; empty payloads are a group like any
other; a null page_id comes after all others in its group; rows equal in payload
and page_id are all responses if theirs is the smallest page_id; an empty table
gives an empty archive and an empty result; other columns aren't archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .exact_dedup import _bits, candidates, repeated_bits

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 8192
DATE = "2000-01-01T00:00:00Z"
ID = "urn:lantern:page:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HEADER_FIELDS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers": "WARC-Refers-To", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "content_length": "Content-Length"}


def base32(sha1: Column) -> Column:
    """Base32 of a hexadecimal SHA-1, five digits at a time."""
    four = (F.lpad(F.conv(F.substring(sha1, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*four), DIGITS, BASE32)


def write(pages: DataFrame, path: str) -> None:
    """Writes one record for each row of ``pages`` (page_id, url, html) to WARC files in the new folder ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32(F.sha1("payload")))
    known = common.cut(rows.select("page_id", "digest"))
    total = known.count()
    bits = _bits(total)
    bitmaps = common.cut(repeated_bits(known, "digest", bits))
    repeated = candidates(known, "digest", bitmaps, bits).filter("candidate")
    groups = common.cut(repeated.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    # payloads that no other record has stay where they are, whatever the size
    marked = candidates(rows, "digest", bitmaps, bits)
    alone = marked.filter("NOT candidate").drop("candidate").withColumn("first_id", F.col("page_id"))
    several = common.join_groups(marked.filter("candidate").drop("candidate"), groups, "digest", "copies", total).drop("copies")
    text = alone.unionByName(several).select(_record().alias("value"))
    text.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _record() -> Column:
    """A record without its closing blank lines."""
    first = F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(first, F.concat(http, F.col("payload"))).otherwise(http)
    kind = F.when(first, F.lit("WARC-Type: response\r\n")).otherwise(
        F.concat(F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first_id"), F.lit("\r\n"))
    )
    header = F.concat(F.lit(MAGIC), kind, F.lit("WARC-Record-ID: "), name("page_id"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"))
    return F.concat(header, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _parsed(value: Column) -> list[Column]:
    """What a piece (all that follows its magic) says: header fields, header bytes, and its payload if it is whole."""
    at = F.instr(value, END)
    head = F.when(at > 0, F.substring(value, F.lit(1), at - 1))
    field = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    fields = [F.nullif(F.trim(field(name)), F.lit("")).alias(k) for k, name in HEADER_FIELDS.items()]
    return [*fields, F.octet_length(head).alias("head_bytes"), F.octet_length(value).alias("bytes")]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Per piece of the files: file, block, n (order within the block), value; value follows a magic, but for a file's first."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def _offsets(pieces: DataFrame) -> DataFrame:
    """``pieces`` (with ``bytes``) with ``offset``, that of their magic; a file's first piece precedes every magic and goes."""
    gap = len(MAGIC)
    blocks = pieces.groupBy(F.col("file").alias("b_file"), F.col("block").alias("b_block")).agg(F.sum(F.col("bytes") + gap).alias("sum"))
    shift = F.coalesce(F.sum("sum").over(Window.partitionBy("b_file").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("b_file", "b_block", shift.alias("shift"))
    own = F.coalesce(F.sum(F.col("bytes") + gap).over(Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = pieces.withColumn("own", own).join(blocks, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    return both.withColumn("offset", F.col("own") + F.col("shift") - gap).filter("offset >= 0").drop("own", "shift", "b_file", "b_block", "block", "n")


def _payload(value: Column) -> Column:
    """The payload's bytes in a whole piece that holds an HTTP response, else the block's bytes."""
    body = F.substring(value.cast("binary"), F.col("head_bytes") + len(END) + 1, F.col("content_length").cast("int"))
    text = F.substring(value, F.length(F.substring_index(value, END, 1)) + len(END) + 1, F.lit(1 << 30))
    http = F.octet_length(F.substring_index(text, END, 1)) + len(END)
    return F.when(F.substring(text, 1, 5) == "HTTP/", F.substring(body, http + 1, F.greatest(F.col("content_length").cast("int") - http, F.lit(0)))).otherwise(body)


def _with_payload(pieces: DataFrame) -> DataFrame:
    """Adds read_digest and read_bytes of whole pieces; announced is the length that the HTTP header gives."""
    # the length is what decides where the next record starts; one that isn't a number ends the chain
    length = F.col("content_length").try_cast("long")
    pieces = pieces.withColumn("whole", F.coalesce(F.col("bytes") == F.col("head_bytes") + 2 * len(END) + length, F.lit(False)))
    payload = F.when(F.col("whole"), _payload(F.col("value")))
    announced = F.regexp_extract(F.col("value"), r"(?is)^.*?\r\n\r\nHTTP/.*?\r\nContent-Length:[ \t]*(\d+)", 1)
    return pieces.withColumn("read_digest", base32(F.sha1(payload))).withColumn("read_bytes", F.octet_length(payload).cast("long")).withColumn("announced", F.nullif(announced, F.lit("")).try_cast("long"))


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, offset, next), those on the chain from their file's offset 0, by pointer jumping.

    Candidates that each lead to the very next one are a run; only where a chain
    enters a run matters. Pointers jump between these entries: one for each
    file, and more only where payloads hold the magic.
    """
    by_file = Window.partitionBy("file").orderBy("offset")
    starts = F.coalesce(F.lag("next").over(by_file) != F.col("offset"), F.lit(True)).cast("long")
    known = common.cut(candidates.withColumn("starts", starts).withColumn("run", F.sum("starts").over(by_file)).drop("starts"))
    exits = known.groupBy("file", "run").agg(F.max_by("next", "offset").alias("exit"), F.min("offset").alias("first"))
    targets = exits.select("file", F.explode(F.array("exit", F.when(F.col("first") == 0, F.lit(0)))).alias("offset")).filter("offset IS NOT NULL").distinct()
    entries = known.join(targets, ["file", "offset"], "left_semi").select("file", "run", "offset").join(exits, ["file", "run"]).select("file", "run", "offset", F.col("exit").alias("next"))
    entries = common.cut(entries)
    reached, jumps = entries.filter("offset = 0").select("file", "offset"), _joined(entries, entries)
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reached = common.cut(reached.unionByName(ahead).distinct())
        jumps = _joined(jumps, jumps.select("file", "offset", "next"), "after")
    first = reached.join(entries, ["file", "offset"]).groupBy("file", "run").agg(F.min("offset").alias("entry"))
    return known.join(first, ["file", "run"]).filter("offset >= entry").drop("run", "entry")


def _joined(jumps: DataFrame, following: DataFrame, then: str = "next") -> DataFrame:
    """Jumps that land on an entry of ``following``, as they are or (``after``) going on from there."""
    landing = following.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
    return common.cut(jumps.join(landing, ["file", "next"]).select("file", "offset", F.col(then).alias("next")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the WARC files in ``path``: the header fields, read_bytes and read_digest of the payload read, and announced."""
    kept = [*HEADER_FIELDS, "head_bytes", "bytes", "whole", "read_digest", "read_bytes", "announced"]
    parsed = _pieces(spark, path).select("file", "block", "n", "value", *_parsed(F.col("value")))
    found = _offsets(common.cut(_with_payload(parsed).select("file", "block", "n", *kept)))
    after = F.col("offset") + len(MAGIC) + F.col("head_bytes") + 2 * len(END) + F.col("content_length").try_cast("long")
    chain = common.cut(reachable(common.cut(found.withColumn("next", after).filter("type IS NOT NULL"))))
    whole = chain.filter("whole").select(*kept)
    if chain.filter("NOT whole").isEmpty():
        return whole
    # a piece belongs to the last record that starts at or before it, by a running maximum over its file
    starts = chain.select("file", "offset", "next", F.col("whole").alias("is_whole"))
    pieces = _offsets(_pieces(spark, path).withColumn("bytes", F.octet_length("value")))
    placed = pieces.join(starts, ["file", "offset"], "left")
    here = F.when(F.col("next").isNotNull(), F.struct("offset", "next", "is_whole"))
    record = F.last(here, True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    parts = placed.select("file", "offset", "value", record.alias("r")).filter("NOT r.is_whole AND offset < r.next")
    joined = parts.groupBy("file", "r.offset").agg(F.sort_array(F.collect_list(F.struct(F.col("offset").alias("at"), "value"))).alias("parts")).select(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    mended = _with_payload(joined.select("value", *_parsed(F.col("value")))).select(*kept)
    return whole.unionByName(mended)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.regexp_extract(F.col(c), f"^<{ID}(.*)>$", 1).try_cast("long")
    response = F.col("type") == "response"
    return read(spark, path).select(
        number("record_id").alias("page_id"),
        F.when(response, F.col("read_bytes")).otherwise(F.col("announced")).alias("payload_bytes"),
        F.when(response, F.col("read_digest")).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(~response, number("refers")).alias("refers_to"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.ensure_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = common.cut(page_records(spark, path))
    common.delete(spark, path)
    return records


OP7_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_id,
         translate({" || ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT), 32), 4, '0')" for i in range(8))}, '{DIGITS}', '{BASE32}') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""
