"""A batch run over image files that does only what has not been done: tables of stages, known by content.

Under one folder lie Parquet tables: ``files`` (path, size and time of each file seen, with the SHA-256 of its content), ``results``
(the pixel stages, by content and by the settings they depend on), ``judged`` (objects with their filter verdicts, by content, those settings and
the filters), ``settings`` (what each key stands for) and ``log`` (what each run computed and what it found done).
A run lists the files, reads the content of those that are new or changed, and anti-joins the other stages on their keys. What
it adds to a table is one partition named after the run, overwritten dynamically: a run that is repeated under its name replaces its own rows only,
and rows of equal keys are equal. Images that can't be read or measured are rows with an ``error``, and are known as such next time.

The driver holds the names of files to be read, as any reader of files does; contents and results stay on the executors.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators import filters as fl
from lacuna.operators import statistics as stat
from lacuna.raster import detection as det
from lacuna.raster import segmentation as seg
from lacuna.sources import images as im

#: Files that one read names.
FILES_A_READ = 10_000
#: Images that a task of the pixel stages gets on average, at most.
IMAGES_A_TASK = 500

_FILES = "path string, name string, length bigint, modified timestamp, sha string, run string"
_RESULTS = f"sha string, {im.RESULT}, settings string, run string"
_LOG = "run string, stage string, settings string, computed bigint, reused bigint, failed bigint, at timestamp"
_SETTINGS = "settings string, stage string, tree string, run string"


def key_of(*settings: object) -> str:
    """A hash of settings: dataclasses, lists and plain values, by their content."""
    return hashlib.sha256(tree_of(*settings).encode()).hexdigest()[:24]


def tree_of(*settings: object) -> str:
    def plain(x):
        if dataclasses.is_dataclass(x):
            return {type(x).__name__: dataclasses.asdict(x)}
        return str(x)

    return json.dumps(settings, sort_keys=True, default=plain)


class StageTables:
    """The stage tables under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run or uuid.uuid4().hex

    # -- tables -----------------------------------------------------------------------------

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, table: str, schema: str | T.StructType) -> DataFrame:
        if not self._exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _add(self, rows: DataFrame, table: str, *parts: str) -> None:
        """Put ``rows`` in place as this run's partition; other runs' stay."""
        out = rows.withColumn("run", F.lit(self.run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(*parts, "run").parquet(self._path(table))

    def log(self) -> DataFrame:
        """run, stage, settings, computed, reused, failed, at."""
        return self.table("log", _LOG)

    def _tell(self, stage: str, settings: str, computed: int, reused: int, failed: int, tree: str = "") -> None:
        row = self.spark.createDataFrame([(stage, settings, computed, reused, failed)], "stage string, settings string, computed bigint, reused bigint, failed bigint")
        self._add(row.withColumn("at", F.current_timestamp()), "log", "stage")
        if tree:
            self._add(self.spark.createDataFrame([(settings, stage, tree)], "settings string, stage string, tree string"), "settings", "stage")

    def settings(self) -> DataFrame:
        """settings (a key), stage, tree (what it stands for), run."""
        return self.table("settings", _SETTINGS)

    # -- stages -----------------------------------------------------------------------------

    def _contents(self, paths: Sequence[str]) -> Iterator[DataFrame]:
        for some in batched(paths, FILES_A_READ):
            yield self.spark.read.format("binaryFile").load(list(some))

    def files(self, folder: str, recursive: bool = False) -> DataFrame:
        """path, name, sha of the image files under a folder; content is read only of files whose path, size or time is new."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        now = found.where(F.col("path").rlike(im.IMAGE_NAME)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))
        same = ["path", "length", "modified"]
        known = self.table("files", _FILES)
        fresh = [r["path"] for r in now.join(known, same, "left_anti").select("path").toLocalIterator()]
        total = now.count()
        for n, some in enumerate(self._contents(fresh)):
            read = some.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"))
            StageTables(self.spark, self.root, f"{self.run}-{n}")._add(read, "files")
        self._tell("files", "", len(fresh), total - len(fresh), 0)
        known = self.table("files", _FILES).dropDuplicates(same)
        return now.join(known.select(*same, "sha"), same).select("path", "name", "sha")

    def analysed(self, images: DataFrame, segmentation: seg.Segmentation, detection: det.Detection) -> DataFrame:
        """The pixel stages of ``images``: image_id, name, sha and all that ``sources.images.analysed`` gives.

        ``images`` has image_id, name, sha and either ``path`` (files) or the columns of decoded images; of images of equal content one is computed.
        """
        settings = key_of(segmentation, detection)
        known = self.table("results", _RESULTS).where(F.col("settings") == settings)
        wanted = images.select("sha").distinct()
        stale = wanted.join(known.select("sha"), "sha", "left_anti")
        first = images.join(stale, "sha", "left_semi").dropDuplicates(["sha"])
        computed = stale.count()
        if "path" in images.columns:
            of = first.select("path", "sha")
            parts = []
            for some in self._contents([r["path"] for r in of.select("path").toLocalIterator()]):
                read = im.decoded(some.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content"))
                good = im.analysed(read.where("error IS NULL").withColumnRenamed("path", "image_id"), segmentation, detection)
                bad = read.where("error IS NOT NULL").select(F.col("path").alias("image_id"), "name", "error")
                parts.append(good.unionByName(bad, allowMissingColumns=True).join(of.withColumnRenamed("path", "image_id"), "image_id"))
        else:
            # Kernels take long for few bytes: a number of partitions that adaptive execution leaves alone keeps them apart, whatever their size in bytes.
            tasks = max(self.spark.sparkContext.defaultParallelism * 2, computed // IMAGES_A_TASK + 1)
            # Results are known by content, so they take its key through the kernels and no pixels are joined.
            apart = first.withColumn("image_id", F.col("sha")).repartition(tasks, "sha")
            parts = [im.analysed(apart, segmentation, detection).withColumn("sha", F.col("image_id"))]
        if computed:
            for n, rows in enumerate(parts):
                StageTables(self.spark, self.root, f"{self.run}-{n}")._add(rows.withColumn("settings", F.lit(settings)), "results", "settings")
        known = self.table("results", _RESULTS).where(F.col("settings") == settings).dropDuplicates(["sha"]).drop("settings", "run", "image_id", "name")
        own = [c for c in ("image_id", "name", "sha", "um_per_px") if c in images.columns]
        names = images.select(*own) if "image_id" in images.columns else images.select(F.col("path").alias("image_id"), "name", "sha")
        out = names.join(known.drop(*(c for c in ("um_per_px",) if c in names.columns)), "sha")
        failed = out.where("error IS NOT NULL").count()
        self._tell("results", settings, computed, wanted.count() - computed, failed, tree_of(segmentation, detection))
        return out

    def judged(self, results: DataFrame, segmentation: seg.Segmentation, detection: det.Detection, filters: Sequence[fl.Setting] = fl.DEFAULT) -> DataFrame:
        """The objects of ``results`` with filter_name and reason; pixels are not looked at."""
        settings = key_of(segmentation, detection, list(filters))
        fine = results.where("error IS NULL")
        # A scale belongs to the image, and filters look at it.
        keys = fine.select("sha", F.coalesce(F.col("um_per_px"), F.lit(0.0)).alias("scale")).distinct()
        schema = fl.apply(im.objects(fine), tuple(filters)).drop("image_id", "name").schema
        schema = T.StructType([T.StructField("sha", T.StringType()), T.StructField("scale", T.DoubleType()), *schema.fields, T.StructField("settings", T.StringType()), T.StructField("run", T.StringType())])
        known = self.table("judged", schema).where(F.col("settings") == settings)
        stale = keys.join(known.select("sha", "scale").distinct(), ["sha", "scale"], "left_anti")
        computed = stale.count()
        if computed:
            one = fine.withColumn("scale", F.coalesce(F.col("um_per_px"), F.lit(0.0))).join(stale, ["sha", "scale"], "left_semi").dropDuplicates(["sha", "scale"])
            # What an image is known by takes its name's place while its objects are judged; an image without objects is kept as a row of nulls.
            named = one.withColumn("image_id", F.concat_ws(" ", "sha", F.col("scale").cast("string")))
            rows = fl.apply(im.objects(named), tuple(filters)).drop("name")
            rows = named.select("image_id", "sha", "scale").join(rows, "image_id", "left").drop("image_id")
            self._add(rows.withColumn("settings", F.lit(settings)), "judged", "settings")
        self._tell("judged", settings, computed, keys.count() - computed, 0, tree_of(segmentation, detection, list(filters)))
        known = self.table("judged", schema).where(F.col("settings") == settings).where("label IS NOT NULL").dropDuplicates(["sha", "scale", "label"]).drop("settings", "run")
        names = fine.select("image_id", "name", "sha", F.coalesce(F.col("um_per_px"), F.lit(0.0)).alias("scale"))
        return names.join(known, ["sha", "scale"]).drop("sha", "scale")

    def tables(self, results: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The table of images, and the failures (image_id, name, error)."""
        columns = ["image_id", "name", "width", "height", "specimen_area_px", "um_per_px"]
        return stat.per_image(results.where("error IS NULL").select(*columns), judged), results.where("error IS NOT NULL").select("image_id", "name", "error")


def run(spark: SparkSession, folder: str, root: str, segmentation: seg.Segmentation | None = None, detection: det.Detection | None = None, filters: Sequence[fl.Setting] = fl.DEFAULT, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All image files of a folder: table of images, objects with verdicts, failures; with what earlier runs left under ``root``."""
    stages = StageTables(spark, root, name)
    segmentation, detection = segmentation or seg.Segmentation(), detection or det.Detection()
    results = stages.analysed(stages.files(folder), segmentation, detection)
    judged = stages.judged(results, segmentation, detection, filters)
    images, failures = stages.tables(results, judged)
    return images, judged, failures


def content_key(images: DataFrame) -> Column:
    """What decoded images are known by: their size and pixels."""
    return F.sha2(F.concat(F.concat_ws("x", F.col("height"), F.col("width")).cast("binary"), F.col("gray")), 256)
