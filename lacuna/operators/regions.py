"""Decisions on objects and regions of pixel tables: merging what is close, taking back slivers, resin and specimen.

Labels are tables (image_id, y, x, label). Every rule is a table of regions, a row each, joined back to its pixels by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.session import checkpointed

AREA = ["image_id", "y", "x"]


def outline(labels: DataFrame) -> DataFrame:
    """Pixels of objects that have a side in common with something else: the nearest pixels of two objects are among them."""
    sides = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    shown = labels.select("image_id", "label", "y", "x", sides.alias("s")).select("image_id", "label", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    inner = shown.groupBy("image_id", "label", "y", "x").agg(F.count("*").alias("sides")).where("sides = 4").select("image_id", "label", "y", "x")
    return labels.join(inner, ["image_id", "label", "y", "x"], "left_anti")


def close_pairs(labels: DataFrame, gap: int) -> DataFrame:
    """image_id, a, b (a < b): objects with at most ``gap`` free pixels between them, by rows and columns (Chebyshev distance gap + 1).

    Outline pixels meet by cells of gap + 1 pixels and their neighbours, so pairs of pixels are in proportion to the outline.
    """
    reach = gap + 1
    edge = outline(labels).withColumns({"cy": F.floor(F.col("y") / reach), "cx": F.floor(F.col("x") / reach)})
    # Of two cells beside each other one asks the other: its own cell and the four after it in row order.
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    asked = edge.select("image_id", F.col("label").alias("a"), F.col("y").alias("ay"), F.col("x").alias("ax"), "cy", "cx", near.alias("s"))
    asked = asked.select("image_id", "a", "ay", "ax", (F.col("cy") + F.col("s.dy")).alias("cy"), (F.col("cx") + F.col("s.dx")).alias("cx"))
    met = asked.join(edge.withColumnRenamed("label", "b"), ["image_id", "cy", "cx"])
    met = met.where((F.col("a") != F.col("b")) & (F.abs(F.col("ay") - F.col("y")) <= reach) & (F.abs(F.col("ax") - F.col("x")) <= reach))
    return met.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, label, head: the smallest label that pairs reach, for every label; rounds on objects, not on pixels."""
    both = checkpointed(pairs.unionByName(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    heads = checkpointed(labels.select("image_id", "label").distinct().withColumn("head", F.col("label")))
    while True:
        of_b = heads.select("image_id", F.col("label").alias("b"), F.col("head").alias("near"))
        least = both.join(of_b, ["image_id", "b"]).groupBy("image_id", F.col("a").alias("label")).agg(F.min("near").alias("near"))
        lower = heads.join(least, ["image_id", "label"], "left").select("image_id", "label", F.col("head").alias("before"), F.least("head", "near").alias("now"))
        jump = heads.select("image_id", F.col("label").alias("now"), F.col("head").alias("further"))
        after = checkpointed(lower.join(jump, ["image_id", "now"], "left").select("image_id", "label", "before", F.least("now", "further").alias("head")))
        heads = after.drop("before")
        if after.where("head != before").isEmpty():
            return heads


def renumbered(labels: DataFrame, of: str) -> DataFrame:
    """Labels 1, 2, ... in the order of a column; its pixels."""
    number = labels.select("image_id", of).distinct().withColumn("number", F.row_number().over(W.partitionBy("image_id").orderBy(of)).cast("int"))
    return labels.join(number, ["image_id", of]).select("image_id", "y", "x", F.col("number").alias("label"))


def merge_close(labels: DataFrame, gap: int = 1) -> DataFrame:
    """Objects with at most ``gap`` pixels between them become one; numbered from 1 in the order of their smallest former labels."""
    heads = groups(close_pairs(labels, gap), labels)
    return renumbered(labels.join(heads, ["image_id", "label"]).drop("label"), "head")


def undo_slivers(split: DataFrame, original: DataFrame, least: float = 0.15) -> DataFrame:
    """Fragments with less than a share ``least`` of their original object go to its largest fragment (of equal ones the smallest label); then all are renumbered.

    ``split`` and ``original`` are labels; pixels of ``split`` outside all original objects keep theirs.
    """
    whole = original.groupBy("image_id", F.col("label").alias("of")).agg(F.count("*").alias("whole"))
    pixels = split.join(original.select(*AREA, F.col("label").alias("of")), AREA, "left")
    parts = pixels.where("of IS NOT NULL").groupBy("image_id", "of", "label").agg(F.count("*").alias("n")).join(whole, ["image_id", "of"])
    largest = F.max_by("label", F.struct("n", -F.col("label"))).over(W.partitionBy("image_id", "of"))
    target = parts.select("image_id", "of", "label", F.when(F.col("n") / F.col("whole") < least, largest).otherwise(F.col("label")).alias("target"))
    moved = pixels.join(target, ["image_id", "of", "label"], "left").select(*AREA, F.coalesce("target", "label").alias("to"))
    return renumbered(moved, "to")


# -- resin and specimen -------------------------------------------------------------------------


def regions(parts: DataFrame, height: int, width: int) -> DataFrame:
    """A row for each component (image_id, y, x, root): area_frac, contact_frac (pixels on the image's border against its perimeter, corners twice), depth_frac (the
    deepest pixel's distance from the border against half the smaller side)."""
    y, x = F.col("y"), F.col("x")
    contact = (y == 0).cast("int") + (y == height - 1).cast("int") + (x == 0).cast("int") + (x == width - 1).cast("int")
    depth = F.least(y, F.lit(height - 1) - y, x, F.lit(width - 1) - x)
    return parts.groupBy("image_id", "root").agg(F.count("*").alias("area_px"), (F.count("*") / (height * width)).alias("area_frac"), (F.sum(contact) / (2 * (height + width))).alias("contact_frac"), (F.max(depth) / (min(height, width) / 2)).alias("depth_frac"))


def rim_regions(table: DataFrame, min_area: float, min_contact: float, max_depth: float = 1.0) -> DataFrame:
    """``regions`` that can be resin around a specimen: large enough, long enough on the border; where several are, none that reaches deeper than ``max_depth``."""
    fits = table.where((F.col("area_frac") >= min_area) & (F.col("contact_frac") >= min_contact))
    several = F.count("*").over(W.partitionBy("image_id")) > 1
    return fits.withColumn("several", several).where(~F.col("several") | (F.col("depth_frac") <= max_depth)).drop("several")


def median_gray(pixels: DataFrame, *keys: str) -> DataFrame:
    """The exact median of each group, from counts of gray levels: 256 rows a group at most, whatever its size."""
    levels = pixels.groupBy(*keys, "gray").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("gray").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(*keys))
    places = levels.select(*keys, "gray", upto.alias("upto"), total.alias("total"))
    low = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("gray")))
    high = F.min(F.when(F.col("upto") * 2 > F.col("total"), F.col("gray")))
    return places.groupBy(*keys).agg(((low + high) / 2).alias("median"))


def material_contrast(pixels: DataFrame, resin: DataFrame) -> DataFrame:
    """image_id, contrast: how much brighter the rest is than the resin, by medians; 0 where either is empty."""
    sides = pixels.join(resin.select(*AREA, F.lit(True).alias("in_resin")), AREA, "left").withColumn("in_resin", F.col("in_resin").isNotNull())
    medians = median_gray(sides, "image_id", "in_resin").groupBy("image_id").agg(F.max(F.when(F.col("in_resin"), F.col("median"))).alias("resin"), F.max(F.when(~F.col("in_resin"), F.col("median"))).alias("rest"))
    return medians.select("image_id", F.coalesce(F.col("rest") - F.col("resin"), F.lit(0.0)).alias("contrast"))


def assign_islands(pieces: DataFrame, pixels: DataFrame, resin: DataFrame, total: int, least: float = 0.01, largest_only: bool = False) -> DataFrame:
    """image_id, root, area_px, role of each component of what is not resin: ``specimen`` (the largest, and others that are large enough),
    ``resin`` (its median gray is nearer to the resin's than to the largest piece's) or ``dropped``.

    ``pieces`` has image_id, y, x, root; of equally large pieces the one with the smallest root leads.
    """
    gray = pixels.select(*AREA, "gray")
    table = pieces.groupBy("image_id", "root").agg(F.count("*").alias("area_px")).join(median_gray(pieces.join(gray, AREA), "image_id", "root"), ["image_id", "root"])
    of_resin = median_gray(gray.join(resin.select(*AREA), AREA, "left_semi"), "image_id").withColumnRenamed("median", "resin_gray")
    order = W.partitionBy("image_id").orderBy(F.desc("area_px"), "root")
    placed = table.withColumns({"place": F.row_number().over(order), "main_gray": F.first("median").over(order)}).join(of_resin, "image_id", "left")
    like_resin = F.abs(F.col("median") - F.col("resin_gray")) < F.abs(F.col("median") - F.col("main_gray"))
    small = F.lit(True) if largest_only else F.col("area_px") / total < least
    role = F.when(F.col("place") == 1, "specimen").when(F.coalesce(like_resin, F.lit(False)), "resin").when(small, "dropped").otherwise("specimen")
    return placed.select("image_id", "root", "area_px", role.alias("role"))
