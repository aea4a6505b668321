"""CSV files of the result tables: semicolons, UTF-8 with a byte order mark, one file for each table.

A Python data source. Each task writes a part; the commit joins the parts, in order, behind one
header. The result tables are small next to what they summarise; large tables belong in Parquet.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        text = io.StringIO()
        out = csv.writer(text, delimiter=";")
        for row in iterator:
            out.writerow(["" if v is None else v for v in row])
        part = f"{self.path}.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, place = _file_system(part)
        with files.open_output_stream(place) as f:
            f.write(text.getvalue().encode())
        return _Part(task.partitionId(), part)

    def commit(self, messages) -> None:
        files, place = _file_system(self.path)
        head = io.StringIO()
        csv.writer(head, delimiter=";").writerow(self.names)
        with files.open_output_stream(place) as out:
            out.write("﻿".encode() + head.getvalue().encode())
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                _, part = _file_system(m.path)
                with files.open_input_stream(part) as f:
                    while data := f.read(1 << 20):
                        out.write(data)
        self.abort(messages)

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                files, part = _file_system(m.path)
                files.delete_file(part)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.width = path, len(schema.names)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        files, place = _file_system(self.path)
        with files.open_input_stream(place) as f:
            rows = csv.reader(io.StringIO(f.read().decode("utf-8-sig"), newline=""), delimiter=";")
            next(rows, None)
            for row in rows:
                yield tuple(row)


class ResultTable(DataSource):
    """``spark.read.format("result_table").schema(...).load(path)``; all columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "result_table"

    def schema(self) -> str:
        files, place = _file_system(self.options["path"])
        with files.open_input_stream(place) as f:
            head = f.read(1 << 16).decode("utf-8-sig", "ignore").splitlines()[0]
        return ", ".join(f"`{c}` string" for c in head.split(";"))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultTable)


def write(table: DataFrame, path: str) -> None:
    register(table.sparkSession)
    table.write.format("result_table").mode("append").save(path)
