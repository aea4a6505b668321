"""Pixel operators on a table (image_id, y, x, gray): for small images, and to check the raster kernels.

Neighbours are found by equi-joins on shifted coordinates, never by a range join or a cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.raster.basics import joined
from lacuna.session import checkpointed

#: MAD times this estimates a standard deviation (fixed value).
MAD_FACTOR = 1.4826
#: Rows of an image that are joined to components together, and pixels of them that are arrays at once.
STRIPE, TOGETHER = 64, 1 << 18


def median_background(pixels: DataFrame) -> DataFrame:
    """Per image the median gray."""
    return pixels.groupBy("image_id").agg(F.percentile("gray", F.lit(0.5)).alias("background"))


def contrast(pixels: DataFrame) -> DataFrame:
    """Pixels with contrast: background minus gray, so dark is positive."""
    return pixels.join(median_background(pixels), "image_id").select("image_id", "y", "x", "gray", (F.col("background") - F.col("gray")).alias("contrast"))


def mad_threshold(values: DataFrame, value: str, factor: float = 6.0) -> DataFrame:
    """Per image: median, median absolute deviation and median + factor * 1.4826 * MAD."""
    middle = values.groupBy("image_id").agg(F.percentile(value, F.lit(0.5)).alias("median"))
    spread = values.join(middle, "image_id").groupBy("image_id", "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    return spread.select("image_id", "median", "mad", (F.col("median") + factor * MAD_FACTOR * F.col("mad")).alias("threshold"))


def below(pixels: DataFrame, level: float) -> DataFrame:
    return pixels.where(F.col("gray") <= level)


def _line_sums(rows: DataFrame, across: str, along: str, size: int, radius: int, values: list[str]) -> DataFrame:
    """For each place of a line the sum of ``values`` from ``radius`` before to ``radius`` after it; beyond its ends a line is mirrored.

    Running sums along the line, then look-ups in the line's array of them: as much work for any radius.
    """
    line = W.partitionBy("image_id", across)
    upto = line.orderBy(along).rowsBetween(W.unboundedPreceding, 0)
    sums = rows.select("image_id", across, along, *[F.sum(v).over(upto).alias(v) for v in values])
    lines = sums.groupBy("image_id", across).agg(F.array_sort(F.collect_list(F.struct(along, *values))).alias("s"))
    period = max(1, 2 * (size - 1))
    shift = period * -(-radius // period)

    def upto_place(n: Column, v: str) -> Column:
        """The sum of the first n values of the mirrored line, from its beginning on."""
        def first(k: Column) -> Column:
            return F.when(k > 0, F.element_at("s", F.least(F.greatest(k, F.lit(1)), F.lit(size)).cast("int"))[v]).otherwise(0)

        whole, rest = F.floor(n / period), F.pmod(n, F.lit(period))
        one = first(F.lit(size)) + (first(F.lit(size - 1)) - first(F.lit(1)) if size > 2 else F.lit(0))
        back = first(F.lit(size)) + first(F.lit(size - 1)) - first(F.lit(2 * size - 1) - rest)
        return whole * one + F.when(rest <= size, first(F.least(rest, F.lit(size)).cast("int"))).otherwise(back)

    def around(i: Column, v: str) -> Column:
        if size == 1:
            return F.element_at("s", 1)[v] * (2 * radius + 1)
        return upto_place((i + radius + 1 + shift).cast("int"), v) - upto_place((i - radius + shift).cast("int"), v)

    spread = F.posexplode(F.transform("s", lambda e, i: F.struct(*[around(i, v).alias(v) for v in values])))
    return lines.select("image_id", across, spread.alias(along, "e")).select("image_id", across, along, *[F.col("e")[v].alias(v) for v in values])


def local_moments(pixels: DataFrame, height: int, width: int, radius: int) -> DataFrame:
    """image_id, y, x, mean, mean_square of the gray values in a square around each pixel, from sums along rows and then along columns (whole images of one size)."""
    gray = pixels.select("image_id", "y", "x", F.col("gray").cast("bigint").alias("g"), (F.col("gray").cast("bigint") * F.col("gray")).alias("q"))
    rows = _line_sums(gray, "y", "x", width, radius, ["g", "q"])
    both = _line_sums(rows, "x", "y", height, radius, ["g", "q"])
    n = float((2 * radius + 1) ** 2)
    return both.select("image_id", "y", "x", (F.col("g") / n).alias("mean"), (F.col("q") / n).alias("mean_square"))


def _spread() -> Column:
    return F.sqrt(F.greatest(F.col("mean_square") - F.col("mean") * F.col("mean"), F.lit(0.0)))


def local_std(pixels: DataFrame, height: int, width: int, radius: int = 1) -> DataFrame:
    """The standard deviation in a square around each pixel; beyond the edge the image is mirrored."""
    return local_moments(pixels, height, width, radius).select("image_id", "y", "x", _spread().alias("local_std"))


def sauvola(pixels: DataFrame, height: int, width: int, window: int, k: float = 0.2) -> DataFrame:
    """Pixels darker than a threshold that follows the surroundings: image_id, y, x, gray, threshold.

    The threshold is the mean of a window (an even size counts as the next odd one), lowered where the spread is small against half the gray range.
    """
    level = F.col("mean") * (1 + k * (_spread() / 127.5 - 1))
    near = local_moments(pixels, height, width, (window | 1) // 2).select("image_id", "y", "x", level.alias("threshold"))
    return pixels.join(near, ["image_id", "y", "x"]).where(F.col("gray") < F.col("threshold")).select("image_id", "y", "x", "gray", "threshold")


def _stripe_roots(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """The components within each row (image_id, p: places of pixels): their smallest y * width + x, and their pixels."""
    lists = batch.column(batch.schema.get_field_index("p"))
    lengths = lists.value_lengths().to_numpy()
    edges = np.flatnonzero(np.diff(np.cumsum(lengths) // TOGETHER, prepend=-1, append=-1)).tolist()
    for lo, hi in zip(edges, edges[1:]):
        some, owner = batch.slice(lo, hi - lo), np.repeat(np.arange(hi - lo), lengths[lo:hi])
        y, x = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.slice(lo, hi - lo).flatten().flatten())
        order = np.lexsort((x, y, owner))
        y, x, owner = y[order], x[order], owner[order]
        wide, tall = x.max() - x.min() + 3, y.max() - y.min() + 2  # free places between lines and between rows of the batch
        key = (owner * tall + y - y.min()) * wide + x - x.min() + 1
        fresh = np.append(True, key[1:] != key[:-1])
        places = key[fresh]
        pairs = []
        for step in (1, wide - 1, wide, wide + 1):
            at = np.minimum(np.searchsorted(places, places + step), len(places) - 1)
            met = np.flatnonzero(places[at] == places + step)
            pairs.append((met, at[met]))
        root = joined(len(places), *(np.concatenate(side) for side in zip(*pairs, strict=True)))
        of = root[np.cumsum(fresh) - 1]
        together = np.argsort(of, kind="stable")
        begins = np.flatnonzero(np.diff(of[together], prepend=-1))
        y, x, owner = y[together], x[together], owner[together]
        ids = some.column(some.schema.get_field_index("image_id")).take(pa.array(owner[begins]))
        ys, xs = (pa.ListArray.from_arrays(pa.array(np.append(begins, len(v)), pa.int32()), pa.array(v)) for v in (y, x))
        yield pa.record_batch({"image_id": ids, "root": pa.array((y * width + x)[begins]), "ys": ys, "xs": xs})


def components(mask: DataFrame, width: int) -> DataFrame:
    """8-connected components of the pixels of a mask: image_id, y, x, root (the smallest y * width + x).

    Stripes of ``STRIPE`` rows are joined within themselves, each where it lies. Where components go on in the next stripe, rounds on these
    components alone take the smallest root that one touches, then that root's root, until nothing changes.
    """
    kinds = {c: mask.schema[c].dataType.simpleString() for c in ("image_id", "y", "x")}
    kinds["root"] = mask.select((F.col("y") * width + F.col("x")).alias("root")).schema[0].dataType.simpleString()
    stripes = mask.groupBy("image_id", F.floor(F.col("y") / STRIPE).alias("stripe")).agg(F.collect_list(F.struct("y", "x")).alias("p")).select("image_id", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _stripe_roots(batch, width)

    def pixels_of(parts: DataFrame) -> DataFrame:
        spread = parts.select("image_id", F.explode(F.arrays_zip("ys", "xs")).alias("at"), "root").select("image_id", F.col("at.ys").alias("y"), F.col("at.xs").alias("x"), "root")
        return spread.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])

    parts = checkpointed(stripes.mapInArrow(run, f"image_id {kinds['image_id']}, root bigint, ys array<bigint>, xs array<bigint>"))
    local = pixels_of(parts)
    beside = F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1))
    ends = local.where(F.pmod("y", F.lit(STRIPE)) == STRIPE - 1).select("image_id", (F.col("y") + 1).alias("y"), beside.alias("x"), F.col("root").alias("p"))
    begins = local.where(F.pmod("y", F.lit(STRIPE)) == 0).select("image_id", "y", "x", F.col("root").alias("q"))
    both = F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"))))
    edges = checkpointed(ends.join(begins, ["image_id", "y", "x"]).select("image_id", "p", "q").distinct().select("image_id", both.alias("e")).select("image_id", "e.p", "e.q"))
    if edges.isEmpty():
        return local
    roots = checkpointed(edges.select("image_id", "p").distinct().withColumn("root", F.col("p")))
    while True:
        of_q = roots.select("image_id", F.col("p").alias("q"), F.col("root").alias("near"))
        least = edges.join(of_q, ["image_id", "q"]).groupBy("image_id", "p").agg(F.min("near").alias("near"))
        lower = roots.join(least, ["image_id", "p"], "left").select("image_id", "p", F.col("root").alias("before"), F.least("root", "near").alias("now"))
        jump = roots.select("image_id", F.col("p").alias("now"), F.col("root").alias("further"))
        after = checkpointed(lower.join(jump, ["image_id", "now"], "left").select("image_id", "p", "before", F.least("now", "further").alias("root")))
        done = after.where("root != before").isEmpty()
        roots = after.drop("before")
        if done:
            found = parts.withColumnRenamed("root", "p").join(roots, ["image_id", "p"], "left")
            return checkpointed(pixels_of(found.withColumn("root", F.coalesce("root", "p"))))


def hysteresis(extent: DataFrame, core: DataFrame, width: int) -> DataFrame:
    """Components of the extent that hold a core pixel."""
    parts = components(extent, width)
    held = parts.join(core.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").select("image_id", "root").distinct()
    return parts.join(held, ["image_id", "root"], "left_semi").select("image_id", "y", "x", "root")


def labelled(parts: DataFrame, min_size: int = 1) -> DataFrame:
    """Components of at least so many pixels, numbered densely from 1 in the order of their roots."""
    size = parts.groupBy("image_id", "root").agg(F.count("*").alias("area_px")).where(F.col("area_px") >= min_size)
    number = size.withColumn("label", F.dense_rank().over(W.partitionBy("image_id").orderBy("root")).cast("int"))
    return parts.join(number, ["image_id", "root"]).select("image_id", "y", "x", "label")


def measure(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per object: area, centroid, bounding box, mean, smallest and median gray."""
    rows = labels.join(pixels.select("image_id", "y", "x", "gray"), ["image_id", "y", "x"])
    return rows.groupBy("image_id", "label").agg(
        F.count("*").alias("area_px"),
        F.avg("x").alias("centroid_x_px"),
        F.avg("y").alias("centroid_y_px"),
        F.min("x").alias("bbox_x"),
        F.min("y").alias("bbox_y"),
        (F.max("x") - F.min("x") + 1).alias("bbox_w"),
        (F.max("y") - F.min("y") + 1).alias("bbox_h"),
        F.avg("gray").alias("mean_intensity"),
        F.min("gray").alias("min_intensity"),
        F.percentile("gray", F.lit(0.5)).alias("median_intensity"),
    )


def label_at(labels: DataFrame, points: DataFrame, radius: int = 3) -> DataFrame:
    """The label at a point (point_id, image_id, px, py), or the nearest one within the radius; 0 if there is none.

    The pixel that the point rounds to comes first; else the smallest distance from the point itself, then the row, then the column.
    """
    # Pixels are listed by square cells as wide as what a point can see, so a point asks four cells at most, each for one row.
    # Sizes behind an explode are guessed far too low, hence no broadcast.
    side = 2 * radius + 1
    pixel = F.struct("y", "x", "label")
    cells = labels.groupBy("image_id", F.floor(F.col("y") / side).alias("cy"), F.floor(F.col("x") / side).alias("cx")).agg(F.collect_list(pixel).alias("pixels"))
    y, x = F.rint("py").cast("int"), F.rint("px").cast("int")
    ends = [F.floor((at + by) / side) for at in (y, x) for by in (-radius, radius)]
    asked = points.select("point_id", "image_id", "px", "py", F.explode(F.sequence(*ends[:2])).alias("cy"), F.sequence(*ends[2:]).alias("cxs"))
    asked = asked.select("point_id", "image_id", "px", "py", "cy", F.explode("cxs").alias("cx"))
    apart = lambda p: (p["y"] != F.rint("py").cast("int")) | (p["x"] != F.rint("px").cast("int"))
    d2 = lambda p: F.pow(p["x"] - F.col("px"), F.lit(2)) + F.pow(p["y"] - F.col("py"), F.lit(2))
    seen = lambda p: (F.abs(p["y"] - F.rint("py")) <= radius) & (F.abs(p["x"] - F.rint("px")) <= radius)
    hits = F.filter("pixels", lambda p: seen(p) & (~apart(p) | (d2(p) <= radius * radius)))
    nearest = F.array_min(F.transform(hits, lambda p: F.struct(apart(p).alias("apart"), d2(p).alias("d2"), p["y"].alias("y"), p["x"].alias("x"), p["label"].alias("label"))))
    met = asked.join(cells.hint("merge"), ["image_id", "cy", "cx"]).select("point_id", nearest.alias("b"))
    best = met.where("b IS NOT NULL").groupBy("point_id").agg(F.min("b").alias("b"))
    return points.join(best.hint("merge"), "point_id", "left").select("point_id", "image_id", F.coalesce("b.label", F.lit(0)).alias("label"))


def labels_inside(labels: DataFrame, region: DataFrame) -> DataFrame:
    """Objects all of whose pixels lie in the region (image_id, y, x)."""
    marked = labels.join(region.select("image_id", "y", "x", F.lit(1).alias("in_region")), ["image_id", "y", "x"], "left")
    return marked.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.count("in_region").alias("inside")).where("n = inside").select("image_id", "label")
