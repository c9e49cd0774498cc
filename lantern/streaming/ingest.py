"""Incremental ingestion: a file stream whose rows are added to a table once each, whatever is replayed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lantern.sources.checkpoints import ensure_folder, exists, names_in


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Takes in all that is new in ``source`` and stops: of the rows with one ``key`` one is added, ever.

    The keys that were seen are the stream's state, dealt by key, so a batch looks up its own keys alone and never reads the
    table. A batch's rows go to a folder of the batch's number, which a replayed batch writes anew: a stop at any
    moment, be it in the middle of a write, changes nothing. The table belongs to one checkpoint; another one is an error.
    """
    stream = spark.readStream.schema(schema).parquet(_pattern(source))
    rows = (transform(stream) if transform else stream).dropDuplicates([key])

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        name = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if others := {n for n in names_in(spark, target) if n.startswith("batch=") and not n.startswith(f"batch={name}-")}:
            raise ValueError(f"{target} has batches of another checkpoint: {min(others)}")
        batch.write.mode("overwrite").parquet(f"{target}/batch={name}-{number:08d}")

    run = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def ingested(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of a table that ``ingest`` fills."""
    if not exists(spark, target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(target).select(schema.fieldNames())


def replay(spark: SparkSession, source: str, key: str) -> DataFrame:
    """``source`` ingested twice into a new table; the second time nothing is added."""
    base = f"{ensure_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        ingest(spark, source, schema, f"{base}/table", f"{base}/checkpoint", key)
    return ingested(spark, f"{base}/table", schema).select(key)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window of a stream; rows later than ``late`` are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))


def counted(spark: SparkSession, source: str) -> DataFrame:
    """``windowed_counts`` of all that a stream of ``source`` has by now, as a table."""
    base = f"{ensure_folder(spark)}/counts-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(_pattern(source))
    rows = windowed_counts(stream)
    run = rows.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/table")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


def _pattern(source: str) -> str:
    """A stream's source as a pattern, so that it may be a folder or one file."""
    return f"{source[:-1]}[{source[-1]}]"
