"""ZIP archives as a Spark data source: an archive's directory is read first, and its members are dealt to tasks by size.

A partition is a range of members of about ``PART_BYTES`` bytes. A task opens the archive where it lies, by Arrow's file
systems, and reads its own members alone, so neither an archive nor more than one member is ever in memory as a whole.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lantern.sources.sink import opened

NAME = "lantern_archive"
PART_BYTES = 64 << 20
#: Archives of fewer bytes are read at once.
SMALL = 1 << 17


def safe(info: zipfile.ZipInfo) -> bool:
    """Whether a member stays inside the folder it is taken to: no links, no absolute paths, nothing above."""
    name, link = info.filename, info.external_attr >> 28 == 0xA
    return not (link or "\\" in name or name.startswith("/") or ":" in name or ".." in name.split("/"))


def members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The files of an archive; an unsafe member is an error."""
    for info in archive.infolist():
        if not safe(info):
            raise ValueError(f"unsafe member {info.filename!r}")
    return [info for info in archive.infolist() if not info.is_dir()]


@contextmanager
def directory(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive, opened where it lies."""
    system, plain = opened(path)
    with system.open_input_file(plain) as f:
        # an archive's directory is looked for from its end, which Arrow's files don't allow beyond the start of small ones
        with zipfile.ZipFile(io.BytesIO(f.read()) if f.size() < SMALL else f) as archive:
            yield archive


@dataclass
class Members(InputPartition):
    """The members from number ``first`` up to ``last``, exclusive."""

    first: int
    last: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Members]:
        with directory(self.path) as archive:
            sizes = [info.file_size for info in members(archive)]
        out, first, size = [], 0, 0
        for k, n in enumerate(sizes):
            if k > first and size + n > self.part_bytes:
                out.append(Members(first, k))
                first, size = k, 0
            size += n
        return [*out, Members(first, len(sizes))]

    def read(self, partition: Members) -> Iterator[tuple[str, str, bytes]]:
        with directory(self.path) as archive:
            for info in members(archive)[partition.first : partition.last]:
                yield self.path, info.filename, archive.read(info)


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "archive string, member string, data binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def read_archive(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per member of the archive at ``path``: archive, member, data."""
    spark.dataSource.register(Archive)
    return spark.read.format(NAME).option("part_bytes", part_bytes).load(path)
