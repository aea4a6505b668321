"""What the training-data operators share: the scratch folder, the place of each row, notes on rows, joins with hot keys.

Nothing outside ``lacuna.llm`` imports this module.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Everything between words or characters that counts as white space in the text contracts.
BLANK = r"[\x20\x09-\x0D]+"

#: Rows that go to Python together: a row holds a whole document, so Spark's 10,000 are too many.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A key with more than one part in so many of all rows is hot; so there are no more hot keys than this.
HOT_KEYS = 4096

_left_over: dict[str, SparkSession] = {}


def small_batches(spark: SparkSession) -> None:
    """Set the session to ``BATCH_ROWS``, unless it has a number of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


_heavy: list = []


def heavy(cached):
    """Marks what is remembered between tasks (an ``lru_cache``) as large: tasks of other operators forget it."""
    _heavy.append(cached)
    return cached


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker forgets what other operators than its ``own`` remember, and gives memory that it no longer uses
    back when the task ends: Spark keeps idle workers for later tasks."""

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cached in _heavy:
            if cached.__name__ != own:
                cached.cache_clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset (local tests), a temporary one that is set as checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lacuna-")
    spark.sparkContext.setCheckpointDir(root)
    return f"file://{root}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def close_all() -> None:
    """Delete the intermediate tables of all results given so far; those results can't be read any more."""
    _delete_left_over()
    _left_over.clear()


def _delete_left_over() -> None:
    for path, spark in list(_left_over.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


atexit.register(_delete_left_over)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that are no longer held: Spark deletes them when the driver collects its garbage, which may be much later."""
    for _ in range(2):  # what Python lets go of is garbage for the driver only then
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


class Scratch:
    """Intermediate tables of one operator call, written as Parquet under the shared folder.

    A written table cuts the lineage and survives the loss of an executor. ``drop`` removes
    tables as soon as nothing reads them; what a lazy result still reads goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _left_over[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, *partition_by: str, compression: str = "snappy") -> DataFrame:
        out = df.write.mode("overwrite").option("compression", compression)
        (out.partitionBy(*partition_by) if partition_by else out).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        _delete(self.spark, self.root)
        _left_over.pop(self.root, None)


def id_crc32(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus).cast("bigint"))


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` and further fields, given by name and type."""
    more = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in fields.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be none of the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# -- rows and notes on them -----------------------------------------------------------------


def _row_by_row(docs: DataFrame) -> bool:
    """Whether each row is one row of what is scanned: columns and filters only, as a join or an explode gives a row more than once with the same place."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and plan.deterministic():
        plan = plan.children().head()
    return plan.children().isEmpty()


def placed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns that tell a row again whenever it is read: its file and its number there.

    Gives the frame and the names of both columns. What is not read straight from Parquet files is written to some first.
    """
    file, row = free_name(docs, "_file"), free_name(docs, "_row")

    def with_place(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", at.getField("file_path").alias(file), at.getField("row_index").alias(row))

    if _row_by_row(docs):
        try:
            found = with_place(docs)
            found.schema  # noqa: B018 - analysed here, so that a frame without files is known
            return found, file, row
        except AnalysisException:
            pass
    return with_place(scratch.keep(docs, "placed")), file, row


def open_folder(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _note_name(key: str) -> str:
    return hashlib.sha256(str(key).encode()).hexdigest()


def write_notes(rows: DataFrame, key: str, folder: str) -> None:
    """Write what ``rows`` say as one small file for each value of ``key``: a range of rows of a file of the input, or a task that wrote a part.

    A reader takes the notes of its own input from there, so what is noted meets the rows without any exchange of them.
    The notes of one key are as many as it has rows, at most.
    """

    def write(group: pa.Table) -> pa.Table:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        name = _note_name(group.column(key)[0].as_py())
        staged = f"{base}/{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(staged, compression=None) as out, pa.ipc.new_file(out, group.schema) as w:
            w.write_table(group)
        files.move(staged, f"{base}/{name}")  # a task that is run again puts the same notes in place
        return pa.table({"noted": pa.array([group.num_rows], pa.int64())})

    rows.groupBy(key).applyInArrow(write, "noted bigint").agg(F.sum("noted")).collect()


#: Rows of a file whose notes lie together.
NOTED_ROWS = 1 << 16


def write_row_notes(rows: DataFrame, file: str, row: str, folder: str) -> None:
    """Notes on single rows, known by file and number: those on each ``NOTED_ROWS`` rows of a file lie together, so that no group and no reader
    meets more than these, however large a file is."""
    key = free_name(rows, "range")
    write_notes(rows.withColumn(key, F.concat_ws("#", F.col(file), F.expr(f"`{row}` div {NOTED_ROWS}"))), key, folder)


def noted_runs(batch: pa.RecordBatch, file: str, row: str, size: int = 0) -> Iterator[tuple[str, pa.RecordBatch]]:
    """A batch in runs of rows whose notes lie together, each with their key."""
    for name, part in runs_of(batch, file):
        ranges = part.column(part.schema.get_field_index(row)).to_numpy() // (size or NOTED_ROWS)
        edges = [0, *((ranges[1:] != ranges[:-1]).nonzero()[0] + 1).tolist(), len(ranges)]
        for lo, hi in zip(edges, edges[1:]):
            yield f"{name}#{ranges[lo]}", part.slice(lo, hi - lo)


class Notes:
    """Reads the notes of a key; those of the last key are held."""

    def __init__(self, folder: str):
        self.files, self.base = open_folder(folder)
        self.held: tuple[object, object] = (None, None)

    def of(self, key, made=lambda table: table):
        """What ``made`` makes of a key's notes, None if there are none."""
        if self.held[0] != key:
            path = f"{self.base}/{_note_name(key)}"
            found = self.files.get_file_info(path).type == pafs.FileType.File
            self.held = key, made(pa.ipc.open_file(self.files.open_input_file(path)).read_all()) if found else None
        return self.held[1]


def runs_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """A batch in runs of rows that agree in a column, each with its value."""
    values = batch.column(batch.schema.get_field_index(column)).dictionary_encode()
    codes = values.indices.to_numpy(zero_copy_only=False)
    edges = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield values[lo].as_py(), batch.slice(lo, hi - lo)


def picked_rows(docs: DataFrame, file: str, row: str, noted: DataFrame, scratch: Scratch, name: str, keep: bool) -> DataFrame:
    """Of ``docs`` with their places, the rows noted (``keep``) or all others; without the columns of the places.

    Rows stay where they are read: no text is exchanged, whatever the number of rows noted.
    """
    folder = scratch.path(f"{name}-notes")
    write_row_notes(noted.select(file, row), file, row, folder)
    size = NOTED_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(folder)
        for batch in batches:
            for key, part in noted_runs(batch, file, row, size):
                known = notes.of(key, lambda table: table.column(row).combine_chunks())
                if known is None:
                    if keep:
                        continue
                else:
                    found = pc.is_in(part.column(part.schema.get_field_index(row)), value_set=known)
                    part = part.filter(found if keep else pc.invert(found))
                if part.num_rows:
                    yield part.select([c for c in part.schema.names if c not in (file, row)])

    return docs.mapInArrow(released(run), docs.drop(file, row).schema)


# -- joins ----------------------------------------------------------------------------------


def hot_join(rows: DataFrame, side: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key and in ``size`` how many rows the key has.

    Hot keys, ``HOT_KEYS`` at most whatever the size of the table, are joined where their rows are; no key of the rest is large.
    """
    large = F.coalesce(F.col(size), F.lit(0)) > max(1, total // HOT_KEYS)
    hot, few = F.broadcast(side.where(large)), side.where(~large)
    rest = rows.join(hot.select(key), key, "left_anti").join(few, key, how)
    return rows.join(hot, key).unionByName(rest)
