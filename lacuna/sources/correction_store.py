"""Manual corrections in files, one for each image that has any.

A file is named after the image's stem and the first twelve digits of the SHA-1 of its content, so it follows the image and not
its place: ``<stem>_<sha1>.json`` with ``{"bild": ..., "korrekturen": [...]}``. An image's file in the store's folder hides one in
the former folder. Files are read and written by executors, as tables; saving no corrections for an image deletes its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.placed_files import open_root, place

#: Digits of the SHA-1 in a file's name (fixed value).
DIGITS = 12
_POINTS = "array<array<double>>"
_FILE = f"struct<bild:string,korrekturen:array<struct<aktion:string,x:double,y:double,punkte:{_POINTS}>>>"
LOG = f"key string, seq int, action string, x double, y double, points {_POINTS}"


def key_of(name: Column, sha1: Column) -> Column:
    """What an image's corrections are known by, from its file name and the SHA-1 of its content."""
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.substring(sha1, 1, DIGITS))


def keyed(files: DataFrame) -> DataFrame:
    """Image files (path, name, content) with their ``key`` in place of the content."""
    return files.select("path", "name", key_of(F.col("name"), F.sha1("content")).alias("key"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    from pyarrow import fs

    files, base = open_root(folder)
    there = files.get_file_info(base).type == fs.FileType.Directory and any(x.path.endswith(".json") for x in files.get_file_info(fs.FileSelector(base)))
    if not there:
        return spark.createDataFrame([], "key string, text string")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return read.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("key"), F.decode("content", "UTF-8").alias("text"))


def load(spark: SparkSession, folder: str, former: str | None = None) -> DataFrame:
    """All stored corrections: key, seq (from 0), action, x, y, points (null for point corrections).

    A file that is no JSON, or holds no list, gives no rows.
    """
    texts = _texts(spark, folder)
    if former:
        old = _texts(spark, former)
        texts = texts.unionByName(old.join(texts.select("key"), "key", "left_anti"))
    read = texts.select("key", F.from_json("text", _FILE).alias("f"))
    rows = read.select("key", F.posexplode("f.korrekturen").alias("seq", "k"))
    return rows.select("key", "seq", F.col("k.aktion").alias("action"), F.col("k.x").alias("x"), F.col("k.y").alias("y"), F.col("k.punkte").alias("points"))


def texts_of(log: DataFrame, images: DataFrame) -> DataFrame:
    """file and content of each image's corrections; content is null where ``log`` (key, seq, action, x, y, points) has none. ``images``: key, name."""
    entry = F.struct("seq", F.struct(F.col("action").alias("aktion"), "x", "y", F.col("points").alias("punkte")).alias("k"))
    lists = log.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # an image's corrections are made by hand
    rows = images.select("key", "name").distinct().join(lists, "key", "left")
    text = F.to_json(F.struct(F.col("name").alias("bild"), F.transform("entries", lambda e: e["k"]).alias("korrekturen")))
    return rows.select(F.concat("key", F.lit(".json")).alias("file"), F.when(F.col("entries").isNotNull(), F.encode(text, "UTF-8")).alias("content"))


def save(log: DataFrame, images: DataFrame, folder: str) -> None:
    """Store the corrections of ``images`` (key, name) as they are in ``log``; all files are in place, or none. Other images' files stay."""
    place(texts_of(log, images), folder)
