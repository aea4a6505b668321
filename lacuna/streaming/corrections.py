"""The correction log as a stream: each batch recomputes the images it touches, and only those."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna.operators import corrections as co
from lacuna.operators import statistics as stat


def follow(log: DataFrame, stored: Callable[[], DataFrame], judged: DataFrame, images: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query over a streaming log (image_id, seq, action, label).

    ``stored`` gives the whole log so far, the batch included. ``sink`` gets the new table rows of the
    touched images and the batch's number; it must overwrite by image, so a repeated batch is harmless.
    """

    def each(batch: DataFrame, number: int) -> None:
        touched = batch.select("image_id").distinct()
        corrected = co.apply_points(judged.join(touched, "image_id", "left_semi"), stored().join(touched, "image_id", "left_semi"))
        sink(stat.per_image(images.join(touched, "image_id", "left_semi"), corrected), number)

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ENTRY = "image_id string, seq bigint, action string, label bigint"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An image's log so far: per label the last entry, and the last one that restored it. Entries that come late or again change nothing that is newer."""
    held = json.loads(state.get[0]) if state.exists else {}
    for batch in batches:
        for seq, action, label in zip(batch["seq"].tolist(), batch["action"].tolist(), batch["label"].tolist()):
            for kind in ("last", co.RESTORE) if action == co.RESTORE else ("last",):
                name = f"{label} {kind}"
                if name not in held or held[name][0] < seq:
                    held[name] = [seq, action]
    state.update((json.dumps(held),))
    rows = {(seq, action, int(name.split(" ", 1)[0])) for name, (seq, action) in held.items()}
    yield pd.DataFrame([(key[0], *r) for r in sorted(rows)], columns=["image_id", "seq", "action", "label"])


def folded(log: DataFrame) -> DataFrame:
    """A streaming log (image_id, seq, action, label) as the fold of each image it touches: as many entries as objects were corrected, twice at most.

    The state of an image is its fold so far, so a batch reads itself only, however long the log has become.
    ``corrections.apply_points`` makes the same of the fold as of the whole log.
    """
    rows = log.select(F.col("image_id").cast("string").alias("image_id"), F.col("seq").cast("bigint").alias("seq"), "action", F.col("label").cast("bigint").alias("label"))
    return rows.groupBy("image_id").applyInPandasWithState(_fold, _ENTRY, "held string", "update", GroupStateTimeout.NoTimeout)


def follow_folds(log: DataFrame, judged: DataFrame, images: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """As ``follow``, from the state of each image instead of the stored log."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = batch.select("image_id").distinct()
        of = lambda rows: rows.join(touched, rows["image_id"].cast("string") == touched["image_id"], "left_semi")
        mine, kind = of(judged), judged.schema["image_id"].dataType
        sink(stat.per_image(of(images), co.apply_points(mine, batch.withColumn("image_id", F.col("image_id").cast(kind)))), number)
        batch.unpersist()

    return folded(log).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_images(spark, folder: str) -> DataFrame:
    """Image files as they arrive in a folder: path, name, content."""
    from lacuna.sources.images import IMAGE_NAME

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return rows.where(F.col("path").rlike(IMAGE_NAME)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
