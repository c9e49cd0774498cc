"""A sink of named files as a Spark data source: tasks write aside, the commit publishes.

Each row (path, page) becomes the file ``path`` below a folder. Tasks write their files to a folder of their own attempt; only when
all have ended well are these moved to their places, and what was written aside is deleted in any case. So a task that fails, or
that runs twice, leaves nothing behind. Files are opened by Arrow's file systems (local ones, HDFS, object stores), by the
folder's scheme.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "lantern_pages"


def opened(folder: str):
    """The file system of a folder, and the folder's path on it."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9+.-]*:", folder):
        return fs.LocalFileSystem(), posixpath.abspath(folder)
    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they lie aside and where they belong."""

    moves: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.aside = folder, f".aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = opened(self.folder)
        own, moves = f"{root}/{self.aside}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for row in iterator:
            path = posixpath.normpath(row["path"])
            if path.startswith(("/", "../")) or path in ("..", "."):
                raise ValueError(f"a page outside of its folder: {row['path']!r}")
            with system.open_output_stream(aside := f"{own}/{len(moves)}") as f:
                f.write(row["page"].encode())
            moves.append((aside, f"{root}/{path}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.folder)
        moves = [move for m in messages if m for move in m.moves]
        for parent in sorted({posixpath.dirname(target) for _, target in moves}):
            system.create_dir(parent, recursive=True)
        for aside, target in moves:
            system.move(aside, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.folder)
        if system.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.aside}")


class PageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["folder"])


def write_pages(pages: DataFrame, folder: str) -> None:
    """Writes each page to its path in ``folder``: all of them, or none if any fails."""
    pages.sparkSession.dataSource.register(PageSink)
    pages.select("path", "page").write.format(NAME).mode("append").option("folder", folder).save()
