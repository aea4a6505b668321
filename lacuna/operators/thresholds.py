"""Thresholds of gray images as column expressions on their histograms.

An image's histogram has a row for each level that occurs (256 at most for bytes), summed before anything is exchanged; what follows is windows and arrays over these
rows, whatever the size of the image. Sums of gray values are whole numbers in float64, so equal splits give equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """image_id, level, n: how many pixels have each gray level; values beyond 0 to 255 are levels of their own."""
    return pixels.where(F.col(value).isNotNull()).groupBy("image_id", F.col(value).cast("int").alias("level")).agg(F.count("*").alias("n"))


def _running(levels: DataFrame) -> DataFrame:
    """The histogram with weight and sum up to each level (``w``, ``m``) and of all (``all_w``, ``all_m``)."""
    image = W.partitionBy("image_id")
    upto = image.orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    n, mass = F.col("n").cast("double"), F.col("n").cast("double") * F.col("level")
    return levels.select("image_id", "level", "n", F.sum(n).over(upto).alias("w"), F.sum(mass).over(upto).alias("m"), F.sum(n).over(image).alias("all_w"), F.sum(mass).over(image).alias("all_m"), F.sum(mass * F.col("level")).over(image).alias("all_q"))


def otsu(levels: DataFrame) -> DataFrame:
    """image_id, threshold, separability: the level that splits a histogram best (the lower class includes it), and the share of the variance that this explains.

    Of equal splits the lowest level is taken; an image of one level has threshold 0 and separability 0.
    """
    rest = F.col("all_w") - F.col("w")
    apart = F.col("all_m") * F.col("w") - F.col("m") * F.col("all_w")
    between = F.when(rest > 0, apart * apart / (F.col("w") * rest))
    # between is the variance between the classes times the square of all pixels, as is this variance of all.
    spread = F.col("all_w") * F.col("all_q") - F.col("all_m") * F.col("all_m")
    best = _running(levels).groupBy("image_id").agg(F.min(F.struct((-F.coalesce(between, F.lit(0.0))).alias("less"), "level")).alias("best"), F.first(spread).alias("spread"))
    found = F.col("best.less") < 0
    return best.select("image_id", F.when(found, F.col("best.level")).otherwise(0).cast("double").alias("threshold"), F.when(found & (F.col("spread") > 0), -F.col("best.less") / F.col("spread")).otherwise(0.0).alias("separability"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: Spark may put a column that is named once in its place, also where that is for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def multi_otsu(levels: DataFrame, classes: int = 3) -> DataFrame:
    """image_id, thresholds: the ``classes`` - 1 levels that split a histogram with the largest variance between classes; null if there are fewer levels than classes.

    Values of the best splits of the first j levels into one class more at a time, over arrays of the levels that occur. The cuts are found from the
    last to the first: of those with which the sum comes to the best value, as rounded, the lowest.
    """
    rows = _running(levels).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("level", "w", "m"))).alias("h"))

    def gain(i: Column, j: Column) -> Column:
        """One class of the levels after the first i, up to the first j."""
        before_w = F.when(i > 0, F.element_at("h", F.greatest(i, F.lit(1)))["w"]).otherwise(0.0)
        before_m = F.when(i > 0, F.element_at("h", F.greatest(i, F.lit(1)))["m"]).otherwise(0.0)
        d = F.element_at("h", j)["m"] - before_m
        return d * d / (F.element_at("h", j)["w"] - before_w)

    def sums(best: Column, k: int, j: Column, after: list[Column]) -> Column:
        """The first j levels split into k classes up to each i and one after it, and the classes ``after`` j."""
        return F.transform(F.sequence(F.lit(k), j - 1), lambda i: sum(after, F.element_at(best, i) + gain(i, j)))

    size = F.size("h")
    enough, every = size >= classes, F.sequence(F.lit(1), size)
    rows = rows.withColumn("best1", F.transform(every, lambda j: gain(F.lit(0), j)))

    def best_of(k: int) -> Callable[[Column], Column]:
        return lambda best: F.transform(every, lambda j: F.when(j > k, F.array_max(sums(best, k, j, []))).otherwise(float("-inf")))

    for k in range(1, classes - 1):
        rows = rows.withColumn(f"best{k + 1}", F.when(enough, _once(F.col(f"best{k}"), best_of(k))))
    ends: list[Column] = [size]
    for k in range(classes - 1, 0, -1):
        after = [gain(i, j) for i, j in zip(ends, ends[1:])]
        rows = rows.withColumn("sums", F.when(enough, _once(F.col(f"best{k}"), lambda best: sums(best, k, ends[0], after))))
        rows = rows.withColumn(f"cut{k}", (F.array_position("sums", F.array_max("sums")) + (k - 1)).cast("int"))
        ends.insert(0, F.col(f"cut{k}"))
    return rows.select("image_id", F.when(enough, F.array(*[F.element_at("h", cut)["level"] for cut in ends[:-1]])).cast("array<double>").alias("thresholds"))


def dark_level(pixels: DataFrame, method: str = "otsu", level: int = 0, classes: int = 3, share: float = 0.3, offset: float = 0.0, fall_back: bool = True) -> DataFrame:
    """image_id, threshold: gray up to which pixels are dark, by ``otsu``, ``multiotsu`` (its cut number ``level``; where levels are too few Otsu's, or, without ``fall_back``, no row) or ``percentile``."""
    if method == "percentile":
        return pixels.groupBy("image_id").agg((F.percentile("gray", F.lit(share)) + offset).alias("threshold"))
    levels = histogram(pixels)
    found = otsu(levels).select("image_id", "threshold")
    if method == "multiotsu":
        cuts = multi_otsu(levels, classes)
        cuts = cuts if fall_back else cuts.where("thresholds IS NOT NULL")
        found = found.join(cuts, "image_id").select("image_id", F.coalesce(F.element_at("thresholds", F.least(F.lit(level + 1), F.size("thresholds"))), "threshold").alias("threshold"))
    return found.select("image_id", (F.col("threshold") + offset).alias("threshold"))


def dark_regions(pixels: DataFrame, specimen: DataFrame | None = None, **how) -> DataFrame:
    """Pixels at or below their image's dark level, within the specimen (image_id, y, x): image_id, y, x, gray, threshold."""
    inside = pixels if specimen is None else pixels.join(specimen.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    return inside.join(dark_level(inside, **how), "image_id").where(F.col("gray") <= F.col("threshold")).select("image_id", "y", "x", "gray", "threshold")


def texture_level(texture: DataFrame, value: str, clip: float = 0.99, least: float = 0.0) -> DataFrame:
    """image_id, threshold, separable: the level that parts smooth from structured pixels, on values cut at a share and scaled to bytes.

    Without two kinds (separability under ``least``, or nothing above 0) the threshold is infinite.
    """
    top = texture.groupBy("image_id").agg(F.percentile(value, F.lit(clip)).alias("top"))
    scaled = texture.join(top, "image_id").where("top > 0").select("image_id", "top", F.least(F.greatest(F.floor(F.col(value) / F.col("top") * 255), F.lit(0)), F.lit(255)).alias("gray"))
    found = otsu(histogram(scaled))
    joined = top.join(found, "image_id", "left")
    kinds = F.coalesce((F.col("top") > 0) & (F.col("separability") >= least), F.lit(False))
    return joined.select("image_id", F.when(kinds, F.col("threshold") / 255 * F.col("top")).otherwise(float("inf")).alias("threshold"), kinds.alias("separable"))
