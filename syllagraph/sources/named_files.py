"""A sink that writes each row as one file of the name it gives."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Attempt(WriterCommitMessage):
    """The folder that a task's attempt wrote its files to."""

    folder: str


class NamedFilesWriter(DataSourceWriter):
    """Every attempt of a task writes to a folder of its own; only those that Spark commits are moved into place, so a task that
    is run again leaves one file per name."""

    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator[Row]) -> Attempt:
        system, root = self.place()
        folder = posixpath.join(root, self.staging, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        for row in iterator:
            name = row["file_name"]
            if not name or posixpath.basename(name) != name or name in (".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            with system.open_output_stream(posixpath.join(folder, name)) as out:
                out.write((row["body"] or "").encode())
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root = self.place()
        for m in messages:
            for info in system.get_file_info(fs.FileSelector(m.folder)) if m else ():
                target = posixpath.join(root, info.base_name)
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_file(target)
                system.move(info.path, target)
        self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        system, root = self.place()
        staging = posixpath.join(root, self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class NamedFiles(DataSource):
    """Format named_files: rows (file_name, body) to files in the folder `path`, which all executors reach: a shared mount, or a
    store that pyarrow opens by its address."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_named_files(documents: DataFrame, path: str) -> None:
    """(file_name, body): each body as the file of that name in the folder, in place of one that is there. Names occur once; rows
    with the same name leave one of their bodies. The texts stay where they are made: nothing is shuffled."""
    documents.sparkSession.dataSource.register(NamedFiles)
    documents.select("file_name", "body").write.format("named_files").mode("append").option("path", path).save()
