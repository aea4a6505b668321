"""Aggregates over counted objects, and size distributions.

Everything is a declarative aggregate by image (or another key), so partial results are combined
before the exchange. A density curve adds 96 numbers to each object, again summed before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import formulas as fm

CURVE_POINTS = 96
#: Kernels end at so many bandwidths (fixed value).
CURVE_REACH = 5.0


def per_image(images: DataFrame, judged: DataFrame) -> DataFrame:
    """Per image: count, area, porosity with and without edge objects, density, largest object, rejected count.

    ``judged`` has the objects with a nullable ``filter_name``. Images without objects stay.
    """
    counted, at_edge = F.col("filter_name").isNull(), F.col("touches_image_edge") | F.col("touches_specimen_edge")
    sums = judged.groupBy("image_id").agg(
        F.count(F.when(counted, 1)).alias("pore_count"),
        F.coalesce(F.sum(F.when(counted, F.col("area_px"))), F.lit(0.0)).alias("pore_area_px"),
        F.coalesce(F.sum(F.when(counted & ~at_edge, F.col("area_px"))), F.lit(0.0)).alias("inner_area_px"),
        # the first of equally large ones
        F.max(F.when(counted, F.struct("area_px", (-F.col("label")).alias("o"), "equivalent_diameter_px"))).alias("largest"),
        F.count(F.when(~counted, 1)).alias("rejected_count"),
    )
    out = images.join(sums, "image_id", "left")
    area = F.coalesce("pore_area_px", F.lit(0.0))
    mm2 = fm.area_mm2("specimen_area_px", "um_per_px")
    return out.select(
        *images.columns,
        mm2.alias("specimen_area_mm2"),
        F.coalesce("pore_count", F.lit(0)).alias("pore_count"),
        area.alias("pore_area_px"),
        fm.porosity_pct(area, "specimen_area_px").alias("porosity_pct"),
        fm.porosity_pct(F.coalesce("inner_area_px", F.lit(0.0)), "specimen_area_px").alias("porosity_pct_excl_edge"),
        fm.pore_density(F.coalesce("pore_count", F.lit(0)), mm2).alias("pore_density_per_mm2"),
        F.col("largest.equivalent_diameter_px").alias("largest_diameter_px"),
        fm.length_um(F.col("largest.equivalent_diameter_px"), "um_per_px").alias("largest_diameter_um"),
        F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"),
    )


def batch_summary(image_table: DataFrame) -> DataFrame:
    """One row for the run: images, pores, mean porosity weighted by specimen area, images without a scale."""
    weighted = F.col("specimen_area_px") > 0
    return image_table.agg(
        F.count("*").alias("images"),
        F.sum("pore_count").alias("total_pores"),
        F.when(F.sum(F.when(weighted, F.col("specimen_area_px"))) > 0, 100.0 * F.sum(F.when(weighted, F.col("pore_area_px"))) / F.sum(F.when(weighted, F.col("specimen_area_px")))).alias("mean_porosity_pct"),
        F.count(F.when(F.col("um_per_px").isNull(), 1)).alias("images_without_scale"),
    )


def rejection_counts(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("filter_name").isNotNull()).groupBy("image_id", "filter_name").agg(F.count("*").alias("n"))


def quantile(x: Column | str, p: float) -> Column:
    """With linear interpolation between the ranks; nulls are left out."""
    return F.percentile(x, F.lit(p))


def summary(values: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, D10, D50, D90, min and max by key."""
    v = F.col(value)
    return values.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), quantile(v, 0.1).alias("d10"), quantile(v, 0.5).alias("d50"), quantile(v, 0.9).alias("d90"), F.min(v).alias("min"), F.max(v).alias("max"))


def class_layout(values: DataFrame, key: str, value: str, logarithmic: bool = True) -> DataFrame:
    """Per key: n, class count (Freedman-Diaconis), and what edges and the density curve need."""
    v = F.col(value)
    usable = values.where(v > 0)
    x = F.log10(v) if logarithmic else v
    stats = usable.groupBy(key).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), quantile(x, 0.25).alias("q1"), quantile(x, 0.75).alias("q3"), F.stddev_samp(x).alias("sd"))
    n, iqr, span = F.col("n"), F.col("q3") - F.col("q1"), F.col("x_hi") - F.col("x_lo")
    width = 2 * iqr * F.pow(n.cast("double"), F.lit(-1 / 3))
    classes = (
        F.when(n < 4, F.greatest(F.lit(1), n.cast("int")))
        .when(span <= 0, 1)
        .when(iqr <= 0, F.greatest(F.lit(4), F.least(F.lit(20), F.rint(F.sqrt(n.cast("double"))).cast("int"))))
        .otherwise(F.greatest(F.lit(5), F.least(F.lit(24), F.ceil(span / F.when(width > 0, width)).cast("int"))))
    )
    return stats.withColumn("classes", classes)


def edges(classes: Column, lo: Column, hi: Column, logarithmic: bool = True) -> Column:
    """Class edges from the smallest to the largest value; logarithmic ones start and end on quarter decades."""
    top = F.when(hi <= lo, lo * 1.05 if logarithmic else lo + 1.0).otherwise(hi)
    if logarithmic:
        a, b = F.floor(F.log10(lo) * 4) / 4, F.ceil(F.log10(top) * 4) / 4
        return F.transform(F.sequence(F.lit(0), classes), lambda i: F.pow(F.lit(10.0), a + i * ((b - a) / classes)))
    return F.transform(F.sequence(F.lit(0), classes), lambda i: lo + i * ((top - lo) / classes))


def class_of(value: Column, grid: Column) -> Column:
    """The class, from 0, that a value falls into; what lies outside goes to the first or last one."""
    return F.size(F.filter(F.slice(grid, 2, F.size(grid) - 2), lambda e: value >= e))


def middles(grid: Column, logarithmic: bool = True) -> Column:
    low, high = F.slice(grid, 1, F.size(grid) - 1), F.slice(grid, 2, F.size(grid) - 1)
    return F.zip_with(low, high, lambda a, b: F.sqrt(a * b) if logarithmic else (a + b) / 2.0)


def histogram(values: DataFrame, key: str, value: str, logarithmic: bool = True) -> DataFrame:
    """A row for each class: key, class, lower and upper edge, middle, count; empty classes included."""
    layout = class_layout(values, key, value, logarithmic).select(key, edges(F.col("classes"), F.col("lo"), F.col("hi"), logarithmic).alias("grid"))
    filled = values.where(F.col(value) > 0).join(layout, key).groupBy(key, class_of(F.col(value), F.col("grid")).alias("class")).agg(F.count("*").alias("count"))
    frame = layout.select(key, F.posexplode(F.arrays_zip(F.slice("grid", 1, F.size("grid") - 1).alias("lower"), F.slice("grid", 2, F.size("grid") - 1).alias("upper"), middles(F.col("grid"), logarithmic).alias("middle"))).alias("class", "e"))
    return frame.join(filled, [key, "class"], "left").select(key, "class", F.col("e.lower").alias("lower"), F.col("e.upper").alias("upper"), F.col("e.middle").alias("middle"), F.coalesce("count", F.lit(0)).alias("count"))


def density_curve(values: DataFrame, key: str, value: str) -> DataFrame:
    """A kernel density on the logarithm, scaled to the histogram's counts: key, point, x, height.

    Keys with fewer than five values, or without spread, have no curve.
    """
    layout = class_layout(values, key, value)
    robust = (F.col("q3") - F.col("q1")) / 1.349
    sigma = F.when(robust > 0, F.least("sd", robust)).otherwise(F.col("sd"))
    layout = layout.where("n >= 5").withColumn("sigma", sigma).where("sigma > 0")
    grid = edges(F.col("classes"), F.col("lo"), F.col("hi"))
    layout = layout.select(key, (0.9 * F.col("sigma") * F.pow(F.col("n").cast("double"), F.lit(-1 / 5))).alias("h"), F.log10(F.get(grid, F.lit(0))).alias("a"), F.log10(F.element_at(grid, -1)).alias("b"), "classes")
    # A value meets the curve's points in columns: a row stays a row, and tasks sum before anything is exchanged.
    at = lambda point: F.col("a") + (F.col("b") - F.col("a")) * point / (CURVE_POINTS - 1)
    u = [(at(k) - F.col("x")) / F.col("h") for k in range(CURVE_POINTS)]
    met = values.where(F.col(value) > 0).select(key, F.log10(F.col(value)).alias("x")).join(layout.select(key, "h", "a", "b"), key)
    sums = met.groupBy(key).agg(*[F.sum(F.when(F.abs(d) < CURVE_REACH, F.exp(-0.5 * d * d)).otherwise(0.0)).alias(f"s{k}") for k, d in enumerate(u)])
    points = layout.join(sums, key).select(key, "h", "a", "b", "classes", F.posexplode(F.array(*[f"s{k}" for k in range(CURVE_POINTS)])).alias("point", "s"))
    factor = (F.col("b") - F.col("a")) / F.col("classes") / (F.col("h") * F.sqrt(2 * F.pi()))
    return points.select(key, "point", F.pow(F.lit(10.0), at(F.col("point"))).alias("x"), (factor * F.col("s")).alias("height"))


#: Diameter classes of the evaluation template, right-open; the last has no end.
DIAMETER_EDGES = (0.0, 10.0, 25.0, 50.0, 100.0)


def diameter_classes(objects: DataFrame, key: str, diameter: Column) -> DataFrame:
    starts = F.array(*[F.lit(x) for x in DIAMETER_EDGES])
    at = F.size(F.filter(starts, lambda e: diameter >= e)) - 1
    return objects.where(diameter >= DIAMETER_EDGES[0]).groupBy(key, at.alias("class")).agg(F.count("*").alias("count"))
