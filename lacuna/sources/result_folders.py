"""A folder of results for each image: its tables, the settings that they were computed with, a log.

Every file is built on executors, in columns, and put in place by one commit (``placed_files``); the driver moves names only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.placed_files import open_root, place

#: What a CSV file begins with, how its lines end.
MARK, END = "﻿", "\r\n"
#: Folders that one task reads, about.
FOLDERS_A_TASK = 5000
#: Bytes of files that are handed on together when they are read.
_TOGETHER = 16 << 20
_CSV = {"sep": ";", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}


def csv_files(table: DataFrame, file: str, folders: DataFrame) -> DataFrame:
    """The rows of a table as one CSV file in the folder of each image: file, content.

    The column ``bild`` has an image's name; each of ``folders`` (name, folder) gets a file, also without rows. Lines are in the order of labels, then of their texts;
    a file holds what one image has.
    """
    columns = table.columns
    text = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), _CSV)
    number = F.col("label") if "label" in columns else F.lit(0)
    lists = table.groupBy(F.col("bild").alias("name")).agg(F.array_sort(F.collect_list(F.struct(number.alias("label"), text.alias("text")))).alias("lines"))
    rows = folders.select("name", "folder").join(lists, "name", "left")
    body = F.concat(F.array(F.lit(MARK + ";".join(columns))), F.coalesce(F.transform("lines", lambda x: x["text"]), F.array().cast("array<string>")), F.array(F.lit("")))
    return rows.select(F.concat("folder", F.lit(f"/{file}")).alias("file"), F.encode(F.array_join(body, END), "UTF-8").alias("content"))


def files_of(tables: dict[str, DataFrame], folders: DataFrame, settings: str = "", log: DataFrame | None = None) -> DataFrame:
    """All files of a run (file, content): each of ``tables`` by file name, ``settings`` (YAML) beside them, and what the run says of an image.

    ``folders``: name, folder, one row for each image, as ``plans.evaluations.output_folders`` gives them. ``log``: name, run, text; kept under the run's name, so runs add to each other.
    """
    parts = [csv_files(table, file, folders) for file, table in tables.items()]
    if settings:
        parts.append(folders.select(F.concat("folder", F.lit("/einstellungen.yaml")).alias("file"), F.encode(F.lit(settings), "UTF-8").alias("content")))
    if log is not None:
        parts.append(log.join(folders, "name").select(F.concat("folder", F.lit("/log/"), "run", F.lit(".txt")).alias("file"), F.encode("text", "UTF-8").alias("content")))
    return reduce(DataFrame.unionByName, parts)


def write(tables: dict[str, DataFrame], folders: DataFrame, root: str, settings: str = "", log: DataFrame | None = None) -> None:
    """Write ``files_of`` a run under ``root``: all files are in place, or none."""
    place(files_of(tables, folders, settings, log), root)


def read(folders: DataFrame, root: str) -> DataFrame:
    """All files in the folders of images under ``root``: file (with its folder), content. ``folders`` as for ``files_of``.

    Each task lists and reads the folders that it has; neither the driver nor a job of its own lists them all. Nothing is given for a folder that is not there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = open_root(root.rstrip("/"))
        names, contents, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch({"file": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})

        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            for found in files.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True, recursive=True)):
                if found.type != fs.FileType.File:
                    continue
                with files.open_input_stream(found.path) as f:
                    contents.append(f.read())
                names.append(found.path.removeprefix(f"{base}/"))
                held += len(contents[-1])
                if held >= _TOGETHER:
                    yield batch()
                    names, contents, held = [], [], 0
        if names:
            yield batch()

    spark = folders.sparkSession
    # By number, as adaptive execution would put these few bytes into one task.
    tasks = max(2 * spark.sparkContext.defaultParallelism, folders.count() // FOLDERS_A_TASK + 1)
    return folders.select("folder").repartition(tasks, "folder").mapInArrow(run, "file string, content binary")
