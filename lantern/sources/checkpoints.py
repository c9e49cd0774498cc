"""Cutting lineage by tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_TABLES: dict[str, SparkSession] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ensure_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the session or its context names.

    Where neither names one, a cluster uses a folder in the warehouse, which all executors
    share; a local session, as in tests, makes a temporary one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if (of_context := context._jsc.sc().getCheckpointDir()).isDefined():
        return of_context.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lantern-checkpoints"
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lantern-checkpoint-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to a table in the shared folder and read again.

    Unlike ``checkpoint()``, which keeps the estimates of the plan that it cuts
    (a product over all its joins, which explodes in loops), a table has its true
    size. Tables are deleted by ``drop``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{ensure_folder(spark)}/lantern-{spark.sparkContext.applicationId}"
    if folder not in _TABLES:
        _TABLES[folder] = spark
        atexit.register(delete, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written to a table that stays and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` has made; nothing may read them afterwards, nor what was derived from them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is; nothing happens once Spark has stopped."""
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except (AttributeError, OSError, Py4JError):
        return


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes below a path and when it was last written, on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength(), system.getFileStatus(target).getModificationTime()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, on whatever file system it is; none if there is no folder."""
    if not exists(spark, path):
        return []
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]
