"""Sharding by size-tiered compaction, with a versioned manifest.

Arrivals are appended as small immutable shards (one Parquet file for each task that has rows). Shards of similar size
share a tier; when a tier holds ``FAN_IN`` shards, runs of them are merged into files of about the target size; a shard of more
than ``OVERSIZE`` targets is cut. What is valid is said by a manifest alone: version N lists every live shard, and a new version
appears by one rename that fails if another writer was first. Such a rename is atomic on HDFS and on local file systems; an
object store needs a committer of its own. Readers of an older version are
undisturbed until ``vacuum`` removes files that the newest manifest no longer names.

DataFrame functions only; what the driver holds goes to Spark as Arrow tables, as Python on the executors would pickle lists of rows anew. A merge needs no shuffle: each run is read by one task, which reads less than two targets, and
written as one file; runs are planned on the manifest, from file sizes. The manifest has a row for each shard (at 128 MB
a shard 800,000 for 100 TB): one task can write or sort it, and the driver holds the names as any reader of files does.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.llm.shared import free_name

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Sizes in a tier differ by this factor at most.
TIER_BASE = 4
#: A shard of more than so many targets is cut.
OVERSIZE = 2
#: Runs that one Spark job merges.
RUNS_A_JOB = 128
#: Hours after which a writer counts as lost that has neither committed nor given up nor renewed its lease, and seconds after which it renews it.
LEASE_HOURS, RENEWAL_SECONDS = 48, 600
#: Times that an append or a merge commits anew after other writers were first.
RETRIES = 20

MANIFEST = "shard string, bytes bigint, rows bigint, tier int, generation int"


class CommitConflict(RuntimeError):
    """Another writer committed this version first; nothing was changed."""


class ShardStore:
    """Shards and manifests of one dataset under ``root``, a folder that driver and executors share.

    Defined cases: an empty table is appended as no shards, and a store of empty tables reads as no rows with the
    columns appended. Null values, long texts and rows that repeat are kept as they are; all appends have the same columns, whatever their names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._appended = 0

    # -- manifest ---------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max([int(n[1:]) for n in self._names("manifest") if n[:1] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.sql("SELECT '' AS shard, 0L AS bytes, 0L AS rows, 0 AS tier, 0 AS generation WHERE false")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version}")

    def schema(self, version: int | None = None) -> T.StructType | None:
        """The columns of the data, None before the first append."""
        version = self.version() if version is None else version
        if not version:
            return None
        at = self._path(f"{self.root}/manifest/v{version}/_schema")
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return T._parse_datatype_json_string(text)

    def commit(self, manifest: DataFrame, base: int, schema: T.StructType | None = None) -> int:
        """Make ``manifest`` version ``base + 1``: all of it or, on a conflict, nothing."""
        staged = f"{self.root}/manifest/.staged-{uuid.uuid4().hex}"
        schema = schema or self.schema()
        manifest.select("shard", "bytes", "rows", "tier", "generation").coalesce(1).write.parquet(staged)
        if schema is not None:
            out = self._fs.create(self._path(f"{staged}/_schema"))
            out.write(bytearray(schema.json().encode()))
            out.close()
        target = self._path(f"{self.root}/manifest/v{base + 1}")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never replaces what is there
        try:
            if self._fs.exists(target):
                raise CommitConflict(f"version {base + 1} exists")
            context.rename(self._path(staged), target, options)
        except Exception as e:
            self._fs.delete(self._path(staged), True)
            raise e if isinstance(e, CommitConflict) else CommitConflict(str(e)) from e
        return base + 1

    def _change(self, added: DataFrame, removed: list[str], schema: T.StructType | None = None) -> int:
        """Commit a change to the newest version, whichever that is; a conflict if what is to be removed has gone meanwhile."""
        gone = F.broadcast(self.spark.createDataFrame(pa.table({"shard": pa.array(removed, pa.string())})))  # names that the driver holds anyway
        for name in (r["shard"] for r in added.select("shard").collect()):
            if not self._fs.exists(self._path(name)):
                raise CommitConflict(f"{name} was deleted before it was committed")
        for attempt in range(RETRIES):
            base = self.version()
            live = self.manifest(base)
            if removed and live.join(gone, "shard", "left_semi").count() < len(removed):
                raise CommitConflict("a shard to be replaced is live no more")
            try:
                stays = live.join(gone, "shard", "left_anti") if removed else live
                return self.commit(stays.unionByName(added), base, schema)
            except CommitConflict:
                if attempt + 1 == RETRIES:
                    raise
        raise CommitConflict("no attempt was made")

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    @contextmanager
    def _writing(self) -> Iterator[str]:
        """A folder for new shards. It is announced, by a lease that is renewed, while its writer has neither committed nor given up, so ``vacuum`` leaves it alone."""
        name, ended = uuid.uuid4().hex, threading.Event()
        lease = self._path(f"{self.root}/writers/{name}")
        self._fs.create(lease).close()

        def renew() -> None:
            while not ended.wait(RENEWAL_SECONDS):
                self._fs.setTimes(lease, int(time.time() * 1000), -1)

        renewing = threading.Thread(target=renew, daemon=True)
        renewing.start()
        try:
            yield f"{self.root}/shards/{name}"
        finally:
            ended.set()
            renewing.join()
            self._fs.delete(lease, False)

    def _measured(self, folder: str, generation: int) -> DataFrame:
        """Manifest rows of the shards in a folder, from the files themselves."""
        read = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        at = read.metadataColumn("_metadata")
        files = read.select(at.getField("file_path").alias("shard"), at.getField("file_size").alias("bytes"))
        found = files.groupBy("shard", "bytes").agg(F.count("*").alias("rows")).select("shard", "bytes", "rows", tier_of(F.col("bytes")).alias("tier"), F.lit(generation).alias("generation"))
        return self.spark.createDataFrame(found.toArrow())  # a row for each new shard; files are read for them once

    def _rows(self, shards: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*shards)

    # -- operations -------------------------------------------------------------------------

    def append(self, arrivals: DataFrame) -> int:
        """Write the rows as new shards, one for each task that has rows, and commit them."""
        schema = T._parse_datatype_json_string(arrivals.schema.json())
        known = self.schema()
        if known is not None and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in schema]:
            raise ValueError("arrivals have other columns than the store")
        with self._writing() as folder:
            arrivals.write.option("compression", "zstd").parquet(folder)
            added = self._measured(folder, 0)
            self._appended += added.count()
            return self._change(added, [], schema)

    def appended(self) -> int:
        """How many shards this object has appended, before any merge."""
        return self._appended

    def plan(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
        """Merges that are due: shard, merge_group. A tier of shards below the target that holds
        ``fan_in`` or more is cut, in order of size, into runs of about the target."""
        small = self.manifest().coalesce(1).where(F.col("bytes") < target)  # in one task no window needs an exchange
        tier = W.partitionBy("tier")
        due = small.withColumn("in_tier", F.count("*").over(tier)).where(F.col("in_tier") >= fan_in)
        running = F.sum("bytes").over(tier.orderBy("bytes", "shard").rowsBetween(W.unboundedPreceding, -1))
        cut = due.withColumn("k", F.floor(F.coalesce(running, F.lit(0)) / target).cast("int"))
        cut = cut.withColumn("merge_group", F.concat_ws("-", "tier", "k"))
        return cut.withColumn("n", F.count("*").over(W.partitionBy("merge_group"))).where("n > 1").select("shard", "merge_group")

    def oversized(self, target: int = TARGET_BYTES) -> DataFrame:
        """Shards that are to be cut: those of more than ``OVERSIZE`` targets, unless they are a single row."""
        return self.manifest().where((F.col("bytes") > OVERSIZE * target) & (F.col("rows") > 1))

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Cut what is too large and merge until no tier is due; each round is one commit. Returns the newest version."""
        while True:
            large = self.oversized(target).select("shard", "bytes", "rows").collect()
            runs: dict[str, list[str]] = {}
            for row in self.plan(target, fan_in).orderBy("merge_group", "shard").toLocalIterator():
                runs.setdefault(row["merge_group"], []).append(row["shard"])
            if not runs and not large:
                return self.version()
            schema, names = self.schema(), sorted(runs)
            with self._writing() as folder:
                for most, shards in _cuts(large, target):  # a shard's row groups are read by as many tasks as they need
                    self._rows(shards, schema).write.mode("append").option("maxRecordsPerFile", most).option("compression", "zstd").parquet(folder)
                for lo in range(0, len(names), RUNS_A_JOB):
                    parts = [self._rows(runs[g], schema).coalesce(1) for g in names[lo : lo + RUNS_A_JOB]]
                    with self._one_task_for_each():
                        reduce(DataFrame.union, parts).write.mode("append").option("compression", "zstd").parquet(folder)
                self._change(self._measured(folder, self.version()), [r["shard"] for r in large] + [s for g in names for s in runs[g]])

    @contextmanager
    def _one_task_for_each(self) -> Iterator[None]:
        """A union of frames of one partition each would else become one task."""
        name = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, before)

    def vacuum(self) -> None:
        """Delete shard files that the newest manifest doesn't name, and older manifests.

        Files are listed first, then writers at work, then the newest manifest is read: what a writer commits
        in between is named by that manifest, and what it has not committed lies in a folder that it still announces.
        """
        at, found = self._path(f"{self.root}/shards"), []
        files = self._fs.listFiles(at, True) if self._fs.exists(at) else None
        while files is not None and files.hasNext():
            found.append(files.next().getPath())
        staged = [n for n in self._names("manifest") if n.startswith(".staged-")]
        limit, busy = (time.time() - 3600 * LEASE_HOURS) * 1000, set()
        writers = self._path(f"{self.root}/writers")
        for x in self._fs.listStatus(writers) if self._fs.exists(writers) else []:
            if x.getModificationTime() >= limit:
                busy.add(x.getPath().getName())
            else:
                self._fs.delete(x.getPath(), False)
        newest = self.version()
        live = {_key(r["shard"]) for r in self.manifest(newest).select("shard").toLocalIterator()}
        for path in found:
            if path.getName().endswith(".parquet") and path.getParent().getName() not in busy and _key(path.toString()) not in live:
                self._fs.delete(path, False)
        for name in self._names("manifest"):
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < newest or name in staged and not busy:
                self._fs.delete(self._path(f"{self.root}/manifest/{name}"), True)

    def read(self, version: int | None = None, described: bool = False) -> DataFrame:
        """The rows of all live shards; ``described``, with ``shard``, ``shard_bytes`` and ``generation`` (underscores follow where a column has that name).

        The file list of the reader comes from the manifest; it has a name for each shard, no data.
        """
        version = self.version() if version is None else version
        manifest, schema = self.manifest(version), self.schema(version)
        if schema is None:
            raise FileNotFoundError(f"nothing was appended to {self.root}")
        shards = [r["shard"] for r in manifest.select("shard").toLocalIterator()]
        rows = self._rows(shards, schema) if shards else self.spark.createDataFrame(to_arrow_schema(schema).empty_table(), schema)
        if not described:
            return rows
        shard, size, generation = (free_name(rows, n) for n in ("shard", "shard_bytes", "generation"))
        if not shards:
            return rows.withColumns({shard: F.lit("").alias(shard), size: F.lit(0).cast("bigint"), generation: F.lit(0)})
        of = manifest.select(F.col("shard").alias(shard), F.col("bytes").alias(size), F.col("generation").alias(generation))
        named = rows.select("*", rows.metadataColumn("_metadata").getField("file_path").alias(shard))
        # A row for each shard, with three short columns: it is the rows that must not move.
        return named.join(F.broadcast(of), shard).select(*rows.columns, shard, size, generation)


def _key(shard: str) -> str:
    """A shard's folder and file, however its path is written."""
    return "/".join(shard.rsplit("/", 2)[-2:])


def _cuts(large: list, target: int) -> list[tuple[int, list[str]]]:
    """Shards to be cut, by the rows of a file: what a target holds of the shard's own rows, rounded down to a power of two, so jobs are few."""
    cuts: dict[int, list[str]] = {}
    for r in large:
        cuts.setdefault(1 << max(1, r["rows"] * target // r["bytes"]).bit_length() - 1, []).append(r["shard"])
    return sorted(cuts.items())


def tier_of(size: Column) -> Column:
    return F.floor(F.log(float(TIER_BASE), F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def shard(arrivals: list[DataFrame], root: str, target: int = TARGET_BYTES) -> ShardStore:
    """Append each of ``arrivals`` to the store at ``root``, compact it and drop files that are no longer live.

    Defined cases as in ``ShardStore``.
    """
    store = ShardStore(arrivals[0].sparkSession, root)
    for one in arrivals:
        store.append(one)
        store.compact(target)
        store.vacuum()
    return store
