"""Many files written by executors, all of them or none: a data source with a two-phase commit.

A row names a file under the root and has its content; content null means that the file is to go. Tasks write to a folder
for staging; the commit moves names, never content, and an aborted job leaves nothing. A file that is there already is
replaced in one move.

    rows.write.format("placed_files").mode("append").save(root)        # file string, content binary
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def open_root(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, str | None]] = field(default_factory=list)  # name under the root, name in the staging folder (None: to be deleted)


class _Writer(DataSourceWriter):
    def __init__(self, root: str, schema: StructType):
        self.root, self.staging, self.columns = root.rstrip("/"), f".staged-{uuid.uuid4().hex}", schema.names

    def write(self, iterator) -> _Staged:
        files, base = open_root(self.root)
        files.create_dir(f"{base}/{self.staging}", recursive=True)
        done = _Staged()
        for row in iterator:
            name, content = (row[self.columns.index(c)] for c in ("file", "content"))
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} is not a file under the root")
            staged = None
            if content is not None:
                staged = uuid.uuid4().hex
                with files.open_output_stream(f"{base}/{self.staging}/{staged}") as out:
                    out.write(bytes(content))
            done.files.append((name, staged))
        return done

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, base = open_root(self.root)
        made = set()
        for message in filter(None, messages):
            for name, staged in message.files:
                at = f"{base}/{name}"
                if staged is not None:
                    if (folder := at.rsplit("/", 1)[0]) not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    files.move(f"{base}/{self.staging}/{staged}", at)
                elif files.get_file_info(at).type == fs.FileType.File:
                    files.delete_file(at)
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, base = open_root(self.root)
        if files.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.staging}")


class PlacedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema)


def place(rows: DataFrame, root: str) -> None:
    """Write (file, content) rows under the root; all of them, or none."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(PlacedFiles)
    rows.select("file", "content").write.format("placed_files").mode("append").save(root)
