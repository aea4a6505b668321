"""Image files as a table, and the pixel stages of the pipeline as one Arrow operator.

One row is one image. Files that cannot be read become rows with an ``error``, the run goes on. Only
the columns that a kernel needs go to Python, and everything measured comes back as nested rows, so
the relational operators take over from there.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.raster import basics, codec, detection, measure, overlay, replay, segmentation

IMAGE_NAME = r"(?i)\.(png|jpe?g|tiff?|bmp)$"
_OBJECT = "struct<" + ",".join(f"{k}:{v}" for k, v in measure.FIELDS.items()) + ">"
#: Images that a task holds as Python values at once, whatever the size of an Arrow batch.
HELD = 16
#: Bytes of labels from which on images go back to Spark.
TOGETHER = 4 << 20
RESULT = f"image_id string, name string, width int, height int, specimen_area_px bigint, excluded_area_px bigint, resin_fraction double, um_per_px double, thresholds map<string,double>, warnings array<string>, objects array<{_OBJECT}>, labels binary, specimen binary, error string"


def _rows(batch: pa.RecordBatch, held: int = 0) -> Iterator[dict]:
    """The rows of a batch; only a few are Python values at any time."""
    held = held or HELD
    for at in range(0, batch.num_rows, held):
        yield from batch.slice(at, held).to_pylist()


def files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Image files under a folder: path, name, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.col("path").rlike(IMAGE_NAME)).select("path", name.alias("name"), "length", "content")


def decoded(rows: DataFrame) -> DataFrame:
    """path, name and gray pixels of files; ``error`` where a file is no readable image."""
    schema = "path string, name string, height int, width int, gray binary, color binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    gray, color = codec.read(r["content"] or b"")
                    out.append((r["path"], r["name"], *gray.shape, gray.tobytes(), None if color is None else color.tobytes(), None))
                except codec.ImageReadError as e:
                    out.append((r["path"], r["name"], None, None, None, None, str(e)))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.select("path", "name", "content").mapInArrow(run, schema)


def analyse(gray: np.ndarray, seg: segmentation.Segmentation, det: detection.Detection, color: np.ndarray | None = None, overlay_box: overlay.Box | None = None) -> dict:
    """Specimen, objects and their measures for one image."""
    excluded = overlay.mask(gray.shape, overlay_box)
    found = segmentation.segment(gray, seg, color)
    specimen = found.specimen & ~excluded
    labels, depth, detected = detection.detect(gray, specimen, det)
    return {
        "specimen_area_px": int(specimen.sum()),
        "excluded_area_px": int(excluded.sum()),
        "resin_fraction": float(found.resin.mean()),
        "thresholds": list(detected.thresholds.items()),
        "warnings": [*found.notes, *detected.notes],
        "objects": measure.measure(labels, gray, depth, specimen),
        "labels": labels.astype("<i4").tobytes(),
        "specimen": np.packbits(specimen).tobytes(),
    }


def analysed(images: DataFrame, seg: segmentation.Segmentation | None = None, det: detection.Detection | None = None) -> DataFrame:
    """Run the pixel stages on rows (image_id, name, height, width, gray[, color, um_per_px, overlay_box])."""
    seg, det = seg or segmentation.Segmentation(), det or detection.Detection()
    want = [c for c in ("image_id", "name", "height", "width", "gray", "color", "um_per_px", "overlay_box") if c in images.columns]
    schema = images.sparkSession.createDataFrame([], RESULT).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def measured(batch: pa.RecordBatch) -> Iterator[dict]:
        for r in _rows(batch):
            row = {"image_id": str(r["image_id"]), "name": r.get("name"), "width": r["width"], "height": r["height"], "um_per_px": r.get("um_per_px"), "error": None}
            try:
                shape = (r["height"], r["width"])
                gray = np.frombuffer(r["gray"], np.uint8).reshape(shape)
                color = np.frombuffer(r["color"], np.uint8).reshape(*shape, 3) if r.get("color") else None
                box = r.get("overlay_box")
                row |= analyse(gray, seg, det, color, tuple(box.values()) if box else None)
            except Exception as e:  # noqa: BLE001 - a failing image is a row, not the end of the run
                row["error"] = f"{type(e).__name__}: {e}"
            yield {f.name: row.get(f.name) for f in target}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: list[dict] = []
            for row in measured(batch):
                some.append(row)
                if len(some) == HELD or sum(len(x["labels"] or b"") for x in some) >= TOGETHER:
                    yield pa.RecordBatch.from_pylist(some, schema=target)
                    some = []
            if some:
                yield pa.RecordBatch.from_pylist(some, schema=target)

    return images.select(*want).mapInArrow(run, schema)


def objects(results: DataFrame) -> DataFrame:
    """One row for each object of ``analysed``, with its image's scale and specimen area."""
    rows = results.where(F.col("error").isNull()).select("image_id", "name", "um_per_px", "specimen_area_px", F.explode("objects").alias("o"))
    return rows.select("image_id", "name", "um_per_px", "specimen_area_px", "o.*")


def corrected(results: DataFrame, judged: DataFrame, log: DataFrame) -> DataFrame:
    """Manual corrections replayed on pixels: image_id, labels (as in ``analysed``), objects, missed.

    ``results`` are those of ``analysed``, ``judged`` their objects with filter_name and reason, ``log`` has image_id, seq, action, x, y, points
    (null for point corrections). An object tells its label, whether it is counted, why not, which correction drew it, and its area;
    ``missed`` numbers the corrections, from 0, that met nothing. An image without corrections comes back as it was.
    """
    schema = "image_id string, labels binary, objects array<struct<label:int,counted:boolean,reason:string,drawn:int,area_px:bigint>>, missed array<int>"
    rejected = judged.where(F.col("filter_name").isNotNull()).groupBy("image_id").agg(F.collect_list(F.struct("label", "reason")).alias("rejected"))
    logs = log.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "x", "y", "points"))).alias("log"))
    rows = results.where("error IS NULL").select("image_id", "width", "height", "labels").join(rejected, "image_id", "left").join(logs, "image_id", "left")
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(results.sparkSession.createDataFrame([], schema).schema)

    def one(r: dict) -> dict:
        labels = np.frombuffer(r["labels"], "<i4").reshape(r["height"], r["width"])
        automatic = {x["label"]: x["reason"] for x in r["rejected"] or []}
        counted = set(np.unique(labels).tolist()) - {0} - automatic.keys()
        steps = [replay.Correction(x["action"], x["x"], x["y"], tuple((p["x"], p["y"]) for p in x["points"] or ())) for x in r["log"] or []]
        out = replay.replay(labels, counted, automatic, steps)
        area = np.bincount(out.labels.ravel())
        objects = [{"label": k, "counted": k in out.counted, "reason": out.rejected.get(k), "drawn": out.drawn.get(k), "area_px": int(area[k])} for k in sorted(out.counted | out.rejected.keys())]
        return {"image_id": r["image_id"], "labels": out.labels.astype("<i4").tobytes(), "objects": objects, "missed": out.missed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time
                yield pa.RecordBatch.from_pylist([one(batch.slice(k, 1).to_pylist()[0])], schema=target)

    return rows.mapInArrow(run, schema)


def pictures(images: DataFrame, results: DataFrame, judged: DataFrame) -> DataFrame:
    """The picture of results and that of the mask of each image, as PNG: image_id, result_png, mask_png."""
    counted = judged.where(F.col("filter_name").isNull()).groupBy("image_id").agg(F.collect_list("label").alias("counted"))
    rows = images.select(F.col("image_id").cast("string").alias("image_id"), "gray").join(results.where("error IS NULL").select("image_id", "width", "height", "labels", "specimen"), "image_id").join(counted, "image_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                shape = r["height"], r["width"]
                gray, labels = np.frombuffer(r["gray"], np.uint8).reshape(shape), np.frombuffer(r["labels"], "<i4").reshape(shape)
                specimen = np.unpackbits(np.frombuffer(r["specimen"], np.uint8), count=gray.size).reshape(shape).astype(bool)
                shown = codec.result_picture(gray, labels, r["counted"] or []), codec.mask_picture(specimen, labels, r["counted"] or [])
                yield pa.record_batch({"image_id": pa.array([r["image_id"]]), "result_png": pa.array([shown[0]], pa.binary()), "mask_png": pa.array([shown[1]], pa.binary())})

    return rows.mapInArrow(run, "image_id string, result_png binary, mask_png binary")


def overlays(images: DataFrame) -> DataFrame:
    """Scale overlay candidates of each image: image_id, seq, kind, bar, box, label, score, notes."""
    box = "struct<x:int,y:int,w:int,h:int>"
    schema = images.sparkSession.createDataFrame([], f"image_id string, seq int, kind string, bar {box}, box {box}, label {box}, score double, notes array<string>").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def named(v: overlay.Box | None) -> dict | None:
        return None if v is None else dict(zip("xywh", map(int, v), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gray = np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
                for k, c in enumerate(overlay.candidates(gray)):
                    out.append({"image_id": str(r["image_id"]), "seq": k, "kind": c.kind, "bar": named(c.bar), "box": named(c.box), "label": named(c.label), "score": c.score, "notes": list(c.notes)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return images.select("image_id", "height", "width", "gray").mapInArrow(run, schema)


def enlarged(pixels: DataFrame, factor: int) -> DataFrame:
    """Images from a pixel table (image_id, y, x, gray), each pixel repeated in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                lists = some.column(some.schema.get_field_index("p"))
                ends, (ys, xs, values) = np.cumsum(lists.value_lengths().to_numpy()), (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
                ids, shapes, grays = [str(x) for x in some.column(some.schema.get_field_index("image_id")).to_pylist()], [], []
                for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    y, x = ys[lo:hi], xs[lo:hi]
                    gray = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
                    gray[y, x] = np.clip(values[lo:hi], 0, 255)
                    gray = basics.nearest(gray, (gray.shape[0] * factor, gray.shape[1] * factor))
                    shapes.append(gray.shape)
                    grays.append(gray.tobytes())
                heights, widths = zip(*shapes, strict=True)
                yield pa.record_batch({"image_id": ids, "name": [f"{x}.png" for x in ids], "height": pa.array(heights, pa.int32()), "width": pa.array(widths, pa.int32()), "gray": pa.array(grays, pa.binary())})

    # Kernels take long for few bytes: a fixed number of partitions keeps them apart, whatever their size in bytes.
    spread = pixels.sparkSession.sparkContext.defaultParallelism * 2
    grouped = pixels.repartition(spread, "image_id").groupBy("image_id").agg(F.collect_list(F.struct("y", "x", "gray")).alias("p"))
    return grouped.mapInArrow(run, "image_id string, name string, height int, width int, gray binary")


def settings_of(tree: dict) -> tuple[segmentation.Segmentation, detection.Detection]:
    """Settings objects from flat dictionaries ``specimen`` and ``detection``; unknown keys are an error."""

    def build(cls, values: dict):
        nested = {f.name: f.default_factory for f in dataclasses.fields(cls) if f.default_factory is not dataclasses.MISSING}
        return cls(**{k: build(nested[k], v) if k in nested and isinstance(v, dict) else v for k, v in values.items()})

    return build(segmentation.Segmentation, tree.get("specimen", {})), build(detection.Detection, tree.get("detection", {}))
